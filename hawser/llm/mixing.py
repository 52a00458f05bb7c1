"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: SHARE of all words, dealt out by weight; a source's target stops at CAP times its size and the excess is
dealt again among the others. Every source is cut into shards of about ``SHARD_ROWS`` documents by a hash of doc_id (a
source that holds a third of all rows is many shards). The budget is counted in equal blocks of words; blocks go to
sources, and each source's to its shards, by highest quotients v/(2s+1), which gives integer quotas. A shard, its
documents in hash order, is a ring of words; its quota is a run of whole turns plus one arc of blocks that begins at a
seeded place. A document gives the words that lie on the arc, plus all its words a turn.

Only a row a source reaches the driver, and a row a shard the task that deals a source's blocks.

Cases: null or wordless texts have size 0 and give nothing; null source is a source of its own and last in order;
repeated rows each take their own place on the ring; null doc_id hashes like any value; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from ._vec import WHITE
from .io import durable, map_blocks

SHARE, CAP, WEIGHTS, SHARD_ROWS, SEED = 1.5, 2.0, (5, 2, 1), 4096, 17


def apportion(votes: np.ndarray, seats: int) -> np.ndarray:
    """Sainte-Laguë: the ``seats`` highest quotients v/1, v/3, v/5, ...; ties to the earlier party."""
    votes = np.asarray(votes, float)
    total = votes.sum()
    if seats <= 0 or total <= 0:
        return np.zeros(len(votes), np.int64)
    # Rounding at one common divisor picks the highest quotients of some number of seats; the rest is a few steps.
    got = np.floor(votes * (seats / total) + 0.5).astype(np.int64)
    left = int(seats - got.sum())
    if left > 0:
        next_ = np.where(votes > 0, votes / (2 * got + 1), -1.0)
        # Only a party among the ``left`` best next quotients (or tied with them) can gain.
        edge = np.partition(next_, max(0, len(next_) - left))[max(0, len(next_) - left)]
        heap = [(-float(next_[i]), int(i)) for i in np.flatnonzero((next_ >= edge) & (votes > 0))]
        heapq.heapify(heap)
        for _ in range(left):
            _, i = heap[0]
            got[i] += 1
            heapq.heapreplace(heap, (-votes[i] / (2 * int(got[i]) + 1), i))
    elif left < 0:
        last = np.where(got > 0, votes / np.maximum(2 * got - 1, 1), np.inf)
        edge = np.partition(last, min(len(last), -left) - 1)[min(len(last), -left) - 1]
        heap = [(float(last[i]), -int(i)) for i in np.flatnonzero((last <= edge) & (got > 0))]
        heapq.heapify(heap)
        for _ in range(-left):
            _, k = heapq.heappop(heap)
            got[-k] -= 1
            if got[-k] > 0:
                heapq.heappush(heap, (votes[-k] / (2 * int(got[-k]) - 1), k))
    return got


def capped(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Sainte-Laguë with at most ``most`` seats a party; seats above are dealt again among the others."""
    got, open_ = np.zeros(len(votes), np.int64), np.ones(len(votes), bool)
    while True:
        got[open_] = apportion(votes[open_], seats - int(got[~open_].sum()))
        over = open_ & (got > most)
        if not over.any():
            return got
        got[over], open_ = most[over], open_ & ~over


def targets(sizes: list[int], weights: list[float]) -> list[float]:
    """Words wanted of each source."""
    left = SHARE * sum(sizes)
    out = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes))]
    while open_:
        total = sum(weights[i] for i in open_)
        want = {i: left * weights[i] / total for i in open_}
        over = [i for i in open_ if want[i] > CAP * sizes[i]]
        if not over:
            for i in open_:
                out[i] = want[i]
            break
        for i in over:
            out[i] = CAP * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def _sized(docs: DataFrame, keep: dict[str, Column]) -> DataFrame:
    def fn(b):
        inside = ~WHITE[b.buf]
        first = inside.copy()
        if len(first):
            first[1:] &= ~inside[:-1]
            cut = b.starts
            first[cut] |= inside[cut]
        return [b.per_doc(first)]

    return map_blocks(docs, keep, F.col("text"), fn, [T.StructField("__size", T.LongType())])


def place(docs: DataFrame, keep: dict[str, Column], wide: bool = False) -> DataFrame:
    """The ``keep`` columns (joined once at the end where they are ``wide``, as texts are, for the rows that give words; else
    carried along, for all rows) and __size, __source_size, __target, __turns, __from1, __to1, __from2, __to2: whole turns, and the
    two stretches of the document's words (from, to; empty if equal) that lie on the arc."""
    spark = docs.sparkSession
    ship(spark)
    carried = {} if wide else keep
    every = durable(_sized(docs, keep | {"__source": F.col("source"), "__id": F.col("doc_id"), "__row": F.monotonically_increasing_id()}), "mix")
    rows = every.select(*carried, "__source", "__id", "__row", "__size")  # written, so the row numbers stay
    per = rows.groupBy("__source").agg(F.count("*").alias("n"), F.sum("__size").alias("size")).collect()  # a row a source
    per = sorted(per, key=lambda r: (r["__source"] is None, (r["__source"] or "").encode("utf-32-be")))
    want = targets([r["size"] for r in per], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(per))])
    positive = [r["size"] for r in per if r["size"]]
    block = int(np.clip(min(positive, default=0) // 100, 1, 64))
    quota = apportion(np.array(want), round(sum(want) / block)) if per else []
    plan = [(r["__source"], max(1, -(-r["n"] // SHARD_ROWS)), int(r["size"]), float(t), int(q)) for r, t, q in zip(per, want, quota, strict=True)]
    plan = spark.createDataFrame(plan, "p_source string, shards int, __source_size long, __target double, quota long")
    rows = rows.join(plan, F.col("__source").eqNullSafe(F.col("p_source")))
    rows = rows.withColumn("__h", F.xxhash64(F.col("__id").cast("string"), F.lit(SEED))).withColumn("__shard", F.pmod(F.col("__h"), F.col("shards")).cast("int"))
    shards = rows.groupBy("p_source", "__shard").agg(F.sum("__size").alias("length"), F.max("quota").alias("quota"))

    def deal(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("__shard", ignore_index=True)
        got = capped(f.length.to_numpy(float), int(f.quota.iloc[0]), (CAP * f.length.to_numpy()).astype(np.int64) // block) * block
        return pd.DataFrame({"d_source": f.p_source, "d_shard": f["__shard"], "length": f.length, "words": got})

    dealt = shards.groupBy("p_source").applyInPandas(deal, "d_source string, d_shard int, length long, words long")
    begin = F.pmod(F.xxhash64("d_source", "d_shard", F.lit(SEED + 1)), F.greatest("length", F.lit(1)))
    dealt = dealt.withColumn("begin", begin).withColumn("turns", F.when(F.col("length") > 0, F.floor(F.col("words") / F.greatest("length", F.lit(1)))).otherwise(F.lit(0)).cast("long"))
    dealt = dealt.withColumn("arc", F.col("words") - F.col("turns") * F.col("length"))
    rows = rows.join(dealt, F.col("p_source").eqNullSafe(F.col("d_source")) & (F.col("__shard") == F.col("d_shard")))
    ring = Window.partitionBy("p_source", "__shard").orderBy("__h", "__id", "__size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__at", F.sum("__size").over(ring) - F.col("__size"))
    clip = lambda c: F.greatest(F.lit(0), F.least(c - F.col("__at"), F.col("__size"))).cast("long")
    end = F.col("begin") + F.col("arc")
    placed = rows.select(
        *carried, "__row", "__size", "__source_size", "__target", F.col("turns").alias("__turns"),
        clip(F.lit(0)).alias("__from1"), clip(F.greatest(end - F.col("length"), F.lit(0))).alias("__to1"), clip(F.col("begin")).alias("__from2"), clip(F.least(end, F.col("length"))).alias("__to2"),
    )
    return every.select(*keep, "__row").join(placed.where(taken() > 0), "__row") if wide else placed


def taken() -> Column:
    return F.col("__turns") * F.col("__size") + (F.col("__to1") - F.col("__from1")) + F.greatest(F.col("__to2") - F.col("__from2"), F.lit(0))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    p = place(docs, {"doc_id": F.col("doc_id")})
    return p.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken().alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus, in the columns of ``docs``: a row for each whole turn of a document, and one with the words on the arc
    (the text as it stands where that is all of it; two rows where the arc takes both ends of a document, not its middle)."""
    names = docs.columns
    own = {c: f"c{i}" for i, c in enumerate(names)}
    p = place(docs, {k: F.col(f"`{c}`") for c, k in own.items()}, wide=True).withColumnRenamed(own["text"], "__text")
    words = F.regexp_extract_all(F.col("__text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    part = lambda a, z: F.slice(words, F.col(a).cast("int") + 1, F.greatest(F.col(z) - F.col(a), F.lit(0)).cast("int"))
    arc = taken() - F.col("__turns") * F.col("__size")
    cut = F.filter(F.array(F.array_join(part("__from1", "__to1"), ""), F.array_join(part("__from2", "__to2"), "")), lambda t: t != "")
    texts = F.concat(F.array_repeat(F.col("__text"), F.col("__turns").cast("int")), F.when(arc <= 0, F.array().cast("array<string>")).when(arc == F.col("__size"), F.array("__text")).otherwise(cut))
    out = p.where((F.col("__size") > 0) & (taken() > 0)).withColumn("__texts", texts).withColumn("__one", F.explode("__texts"))
    return out.select(*[F.col("__one").alias("text") if c == "text" else F.length("__one").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(k).alias(c) for c, k in own.items()])
