"""MinHash near-duplicates by BagMinHash signatures of shingle multisets.

A text is the multiset of its five-word shingles (of all its words, where they are fewer than five). Every shingle owns a
line of weight, cut into the cells [0, 1), [1, 2), [2, 4), [4, 8), ...; each cell owns a Poisson process whose rate is its
width, each point of which carries a time, a register and, by halving the cell again and again, a place in it. A text
sees the points below its shingle's weight: cells wholly below it are taken whole, the last is thinned by the place. A
register keeps its earliest time. Two texts agree in a register with the probability of their weighted Jaccard
similarity, for integer weights without bias. Processes are run in time order and cut off at a time by which a text's
registers are almost surely full (and on, where one is not), so the cost is about shingles + m log m.

Bands of registers give buckets; of buckets with the same members one is enough. Texts with the same multiset are one node
from the start, so groups of exact copies cost a row each. Links are verified on the multisets: at least SIMILARITY
overlap, sum of smaller counts over sum of larger ones. Links are found in two ways:

* Hubs. A bucket's hub is the node that meets the most others in all its buckets. In a round every node is verified against
  one hub, the best of its buckets, so a round makes at most an edge a node. Nodes whose bucket's hub is in another
  component afterwards go on to the next round, among themselves; rounds end when fewer than HUB_YIELD of the edges hold.
* Blocks. What could still be missing are links between nodes of one bucket that are in different components. Buckets that
  hold several components are dealt to blocks of about BLOCK nodes, and every two blocks of a bucket (and each block alone)
  are verified as one sparse product of their multisets. Every such pair is verified, and only the links that join
  components leave. This work grows with the pairs of texts that meet in a band and are no links; it is spread over tasks
  by block, and a task holds two blocks.

So the classes are those of all links between texts that agree in a band (two texts of similarity 0.8 agree in none with a
probability of 3e-6), and no other rule drops a pair. Components take the smallest doc_id.

Cases: null, empty and wordless texts have no shingle and are no one's copy; rows that share doc_id and shingles are one
document, rows that share doc_id alone are documents of their own; rows without doc_id join no class (class_id null); ties
go to the smaller doc_id; texts of any length; an empty table has no classes; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from ._vec import Block, combine, mix, windows
from .io import durable, map_blocks, small_batches

SHINGLE, SIMILARITY, BANDS, ROWS, SMALL_SET = 5, 0.8, 32, 5, 100_000
#: These set costs only: the share of links that keeps hub rounds going, the edges of a hub in one task, and the nodes,
#: multiset elements and columns of the product held at once.
HUB_YIELD, HUB_EDGES, BLOCK, BLOCK_WEIGHT, COLUMNS = 0.1, 256, 256, 1 << 20, 4096
REGISTERS = BANDS * ROWS

_U = np.uint64


def shingles(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of every distinct shingle, by document."""
    start, end, doc = b.words()
    h = b.hashes(start, end)
    n = np.bincount(doc, minlength=b.n)
    key, at = windows(h, doc, SHINGLE)
    owner = doc[at]
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):
        first = np.searchsorted(doc, few)
        short = np.array([combine([h[a + k : a + k + 1] for k in range(c)] + [np.array([c], _U)])[0] for a, c in zip(first.tolist(), n[few].tolist(), strict=True)], _U)
        key, owner = np.concatenate([key, short]), np.concatenate([owner, few])
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], key[at], np.diff(np.append(at, len(key)))


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(n: int, doc: np.ndarray, key: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """documents x REGISTERS earliest times; inf in documents without shingles."""
    m = REGISTERS
    sig = np.full(n * m, np.inf)
    if not len(doc):
        return sig.reshape(n, m)
    total = np.bincount(doc, weight, n)
    # Cells: level 0 is [0, 1), level j is [2^(j-1), 2^j).
    depth = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
    src = np.repeat(np.arange(len(doc)), depth)
    level = np.arange(len(src)) - np.repeat(np.cumsum(depth) - depth, depth)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1.0))
    width = np.where(level == 0, 1.0, low)
    share = np.minimum((weight[src] - low) / width, 1.0)
    seed = mix(key[src] + level.astype(_U) * _U(0x9E3779B97F4A7C15))
    where = doc[src]
    horizon = (m / np.maximum(total, 1)) * (np.log(m) + 4)
    todo = np.ones(len(src), bool)
    while todo.any():
        idx = np.flatnonzero(todo)
        time, step = np.zeros(len(idx)), 0
        while len(idx):
            h = mix(seed[idx] + _U((step + 1) * 0xD1342543DE82EF95 % 2**64))
            time = time - np.log(_unit(h)) / width[idx]
            near = time <= horizon[where[idx]]
            idx, time, h = idx[near], time[near], h[near]
            g = mix(h ^ _U(0xA0761D6478BD642F))
            seen = _unit(mix(g ^ _U(0xE7037ED1A0B428DB))) < share[idx]
            np.minimum.at(sig, where[idx][seen] * m + (g[seen] % _U(m)).astype(np.int64), time[seen])
            step += 1
        short = ~np.isfinite(sig.reshape(n, m)).all(1)
        horizon = horizon * 2
        todo = short[where]
    return sig.reshape(n, m)


def _identity(b: Block, doc: np.ndarray, key: np.ndarray, weight: np.ndarray, salt: int) -> np.ndarray:
    """One hash of each document's multiset."""
    item = mix(key + weight.astype(_U) * _U(0x9FB21C651E98DF25))
    s = np.zeros(b.n, _U)
    np.add.at(s, doc, mix(item ^ mix(np.full(1, salt, _U))))
    return mix(s).view(np.int64)


def _sketch(b: Block) -> list:
    doc, key, weight = shingles(b)
    sig = signatures(b.n, doc, key, weight)
    total = np.bincount(doc, weight, b.n).astype(np.int64)
    bits = sig.view(_U).reshape(b.n, BANDS, ROWS)
    bands = np.column_stack([combine([np.full(b.n, k, _U), *(bits[:, k, r] for r in range(ROWS))]) for k in range(BANDS)]).view(np.int64)
    return [*(_identity(b, doc, key, weight, k) for k in (1, 2)), total, [x if t else [] for x, t in zip(bands.tolist(), total.tolist(), strict=True)]]


def _keys(b: Block) -> list:
    doc, key, weight = shingles(b)
    return [_identity(b, doc, key, weight, k) for k in (1, 2)]


def _grams(b: Block) -> list:
    """Each text's multiset as a sorted set of 64-bit hashes: the j-th copy of a shingle is an element of its own."""
    doc, key, weight = shingles(b)
    src = np.repeat(np.arange(len(doc)), weight)
    turn = np.arange(len(src)) - np.repeat(np.cumsum(weight) - weight, weight)
    item = mix(key[src] + turn.astype(_U) * _U(0x9E3779B97F4A7C15)).view(np.int64)
    owner = doc[src]
    item = item[np.lexsort((item, owner))]
    cut = np.searchsorted(owner, np.arange(b.n + 1))
    return [_identity(b, doc, key, weight, 1), [item[a:z] for a, z in zip(cut, cut[1:], strict=False)]]


def _few(df: DataFrame) -> DataFrame:
    """Broadcast if the rows are few, as counted; else as it is."""
    return F.broadcast(df) if df.count() <= SMALL_SET else df


def _verified(edges: DataFrame, grams: DataFrame) -> DataFrame:
    """The edges (a: node, b: hub) that are links. A hub with many edges is dealt to several tasks."""
    heavy = _few(durable(edges.groupBy("b").count().where(F.col("count") > HUB_EDGES).select("b", F.ceil(F.col("count") / HUB_EDGES).cast("int").alias("parts")), "hubs"))
    parts = F.coalesce("parts", F.lit(1))
    left = edges.join(heavy, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), parts).cast("int").alias("part"))
    left = left.join(grams.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a")
    hubs = grams.join(edges.select(F.col("b").alias("id")).distinct(), "id", "left_semi").withColumnsRenamed({"id": "b", "g": "gb"})
    hubs = hubs.join(heavy, "b", "left").select("b", "gb", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    shared = F.size(F.array_intersect("ga", "gb"))
    alike = shared + F.lit(1e-9) >= SIMILARITY * (F.size("ga") + F.size("gb") - shared)
    return left.join(hubs, ["b", "part"]).where(alike).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node that a node is linked to, over any number of steps. links: a, b."""
    both = durable(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        # The smallest label next to each node, then the label of that label.
        near = both.join(label.withColumnsRenamed({"node": "b", "comp": "c"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        new = label.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("mid"))
        jump = label.withColumnsRenamed({"node": "mid", "comp": "far"})
        new = durable(new.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("comp")), "labels")
        changed = new.where("old <> comp").limit(1).count()
        label = new.select("node", "comp")
        if not changed:
            return label


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (id, comp) after links between nodes of different components."""
    at = lambda x: comp.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}"))
    between = links.join(at("a"), "a").join(at("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    up = components(between).select(F.col("comp").alias("top"), F.col("node").alias("comp"))
    return durable(comp.join(up, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp")), "comp")


def _runs(batches):
    """Runs of rows of one (bucket, lo, hi), whole, from batches sorted by these: numpy columns i, ids, comps, sizes, elements."""
    names, held, key = ("i", "d", "k", "cd", "ck"), [], None
    whole = lambda parts: [np.concatenate(x) for x in zip(*parts, strict=True)]
    for rb in batches:
        if not rb.num_rows:
            continue
        col = {n: rb.column(n).to_numpy() for n in ("bucket", "lo", "hi", *names)}
        g = rb.column("g")
        offs, flat = g.offsets.to_numpy(), g.values.to_numpy()
        new = np.ones(rb.num_rows, bool)
        new[1:] = (col["bucket"][1:] != col["bucket"][:-1]) | (col["lo"][1:] != col["lo"][:-1]) | (col["hi"][1:] != col["hi"][:-1])
        first = np.flatnonzero(new)
        for a, z in zip(first.tolist(), [*first[1:].tolist(), rb.num_rows], strict=True):
            this = (col["bucket"][a], col["lo"][a], col["hi"][a])
            if held and this != key:
                yield whole(held)
                held = []
            key = this
            held.append([*(col[n][a:z].copy() for n in names), np.diff(offs[a : z + 1]), flat[offs[a] : offs[z]].copy()])
    if held:
        yield whole(held)


def overlaps(size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """How many elements each two of the sets laid end to end share."""
    m = len(size)
    owner = np.repeat(np.arange(m), size)
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[shared] = np.arange(len(shared))
    at = place[at]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((m, m), np.float32)  # exact below 2 ** 24 shared elements
    for lo in range(0, len(shared), COLUMNS):
        a, z = np.searchsorted(at, [lo, lo + COLUMNS])
        part = np.zeros((m, min(COLUMNS, len(shared) - lo)), np.float32)
        part[owner[a:z], at[a:z] - lo] = 1
        out += part @ part.T
    return out


def _meet(batches):
    """Links that join components, of each two blocks of a bucket or of one block."""
    for i, d, k, cd, ck, size, flat in _runs(batches):
        other = (cd[:, None] != cd) | (ck[:, None] != ck)
        other &= np.minimum(size[:, None], size) >= SIMILARITY * np.maximum(size[:, None], size) - 1e-9
        if i.min() != i.max():
            other &= i[:, None] != i
        if not other.any():
            continue
        shared = overlaps(size, flat)
        a, b = np.nonzero(np.triu(other & (shared + 1e-6 >= SIMILARITY * (size[:, None] + size - shared)), 1))
        up = {c: c for c in zip(cd.tolist(), ck.tolist(), strict=True)}

        def top(c):
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        out = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            s, t = top((int(cd[x]), int(ck[x]))), top((int(cd[y]), int(ck[y])))
            if s != t:
                up[max(s, t)] = min(s, t)
                out.append((x, y))
        if out:
            x, y = np.array(out).T
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (d[x], k[x], d[y], k[y])], names=["ad", "ak", "bd", "bk"])


def _by_blocks(members: DataFrame, comp: DataFrame, grams: DataFrame) -> DataFrame:
    """a, b: links between components among all nodes that share a bucket."""
    ship(members.sparkSession)
    small_batches(members.sparkSession)
    placed = durable(members.join(comp, "id").select("bucket", "id", "n", "comp"), "placed")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_WEIGHT)).cast("int").alias("parts")
    several = placed.groupBy("bucket").agg(parts, F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("bucket", "parts")
    rows = placed.join(several, "bucket").withColumn("i", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.join(grams, "id").select("bucket", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "id.d", "id.k", F.col("comp.d").alias("cd"), F.col("comp.k").alias("ck"), "g")
    rows = rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    found = rows.mapInArrow(_meet, "ad long, ak long, bd long, bk long")
    return found.select(F.struct(F.col("ad").alias("d"), F.col("ak").alias("k")).alias("a"), F.struct(F.col("bd").alias("d"), F.col("bk").alias("k")).alias("b"))


def _classed(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, n, class_id, rep_id and first: whether the row has the smallest text of its class; a row for every row."""
    long = T.LongType()
    sig = durable(map_blocks(docs, {"doc_id": F.col("doc_id").cast("long")}, F.col("text"), _sketch, [T.StructField("k1", long), T.StructField("k2", long), T.StructField("n", long), T.StructField("bands", T.ArrayType(long))]), "sketch")
    real = sig.where("n > 0 and doc_id is not null")
    # A node: its smallest doc_id, and a hash of the multiset for doc_ids that several texts share.
    reps = real.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    reps = durable(reps.select("k1", "k2", F.struct(F.col("rep").alias("d"), F.col("k1").alias("k")).alias("id"), "n", "bands"), "reps")
    nodes = reps.select("id", "n", F.explode("bands").alias("bucket"))
    alone = ["met", "lo", "hi", "x", "y"]
    seat = nodes.groupBy("bucket").agg(F.count("*").alias("met"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).where("lo <> hi")
    seat = seat.groupBy(*alone).agg(F.min("bucket").alias("bucket")).select("bucket", "met")  # one of those with the same members
    members = durable(nodes.join(seat, "bucket").select("bucket", "id", "n", "met"), "members")
    met = durable(members.groupBy("id").agg((-F.sum("met")).alias("rank")), "met")
    asked = _few(met.select(F.col("id.d").alias("doc_id")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(asked, "doc_id", "left_semi")
    grams = map_blocks(texts, {"doc_id": F.col("doc_id")}, F.col("text"), _grams, [T.StructField("k", long), T.StructField("g", T.ArrayType(long))])
    grams = durable(grams.select(F.struct(F.col("doc_id").alias("d"), "k").alias("id"), "g"), "grams")

    comp = met.select("id", F.col("id").alias("comp"))
    rest = members.join(met, "id").select("bucket", "id", F.struct("rank", "id").alias("place"))
    while True:
        rest = durable(rest, "rest")
        hub = rest.groupBy("bucket").agg(F.min("place").alias("hub"))
        edges = rest.join(hub, "bucket").where("id <> hub.id").groupBy(F.col("id").alias("a")).agg(F.min("hub").alias("hub"))
        edges = durable(edges.select("a", F.col("hub.id").alias("b")), "edges")
        tried = edges.count()
        links = durable(_verified(edges, grams), "verified")
        held = links.count()
        if held:
            comp = _joined(comp, links)
        if held < max(1, HUB_YIELD * tried):
            break
        # Nodes that are not in the component of their bucket's hub get a hub among themselves.
        rest = rest.join(comp, "id")
        rest = rest.join(rest.groupBy("bucket").agg(F.min_by("comp", "place").alias("hub")), "bucket").where("comp <> hub").select("bucket", "id", "place")
    more = durable(_by_blocks(members, comp, grams), "verified")
    if more.limit(1).count():
        comp = _joined(comp, more)
    named = reps.select("k1", "k2", "id").join(comp, "id", "left").select("k1", "k2", "id", F.coalesce("comp", "id").alias("comp"))
    out = sig.select("doc_id", "k1", "k2", "n").join(named, ["k1", "k2"], "left")
    own = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return out.select(
        "doc_id", "k1", "k2", "n",
        F.when(own, F.col("comp.d")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(own, F.col("id.d")).otherwise(F.col("doc_id")).alias("rep_id"),
        (~own | ((F.col("comp") == F.col("id")) & (F.col("doc_id") == F.col("id.d")))).alias("first"),
    )


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the document's class) and rep_id (the smallest doc_id with the same
    multiset of shingles), a row for every row."""
    return _classed(docs).select("doc_id", "class_id", "rep_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; of every class the text of the smallest doc_id, once. Rows without doc_id stay, and so do
    texts without a word, once a doc_id. Texts that share a doc_id and are not alike both stay."""
    at = durable(_classed(docs).where("doc_id is not null").select("doc_id", "k1", "k2", "first"), "classed")
    shared = durable(at.groupBy("doc_id").count().where("count > 1").select("doc_id"), "shared")
    kept = at.where("first").select("doc_id", "k1", "k2").distinct()
    some = docs.where("doc_id is null")
    if not shared.limit(1).count():
        return docs.join(kept.select("doc_id"), "doc_id", "left_semi").select(*docs.columns).unionByName(some)
    # doc_ids of several rows: which of the rows is a matter of their shingles.
    once = docs.join(kept.join(shared, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi")
    many = docs.join(_few(shared), "doc_id", "left_semi")
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = map_blocks(many, {n: F.col(f"`{c}`") for n, c in zip(names, docs.columns, strict=True)}, F.col("text"), _keys, [T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())])
    own = names[docs.columns.index("doc_id")]
    found = found.join(kept.withColumnRenamed("doc_id", own), [own, "k1", "k2"], "left_semi").dropDuplicates([own, "k1", "k2"])
    found = found.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
    return once.select(*docs.columns).unionByName(found).unionByName(some)
