"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, in flat neighbour arrays.

Equal vectors are one node (a group of copies would be a graph island); a node keeps its k + 1 smallest ids, which is all
that an answer of k can name. Nodes are dealt to shards of about SHARD_ROWS by a hash of the vector. Each shard's graph is
one row: per level an array nodes x M of neighbours, -1 where none. Graphs are built and searched in lockstep: a batch
of vectors takes each step of the beam search together, as numpy operations over the whole batch.

Largest inner product is turned into nearest distance by one more coordinate, sqrt(max|x|^2 - |x|^2), for building
edges; searches compare inner products, and final scores are float64 inner products of the original vectors.

The query set (a stated share of the rows) meets every shard, in blocks; a shard's graph travels once to each GROUP_BLOCKS
blocks, which stream past it. Shard results are merged per query.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids and vectors of
another length than the commonest one (of equally common ones the smallest); rows repeated whole count once; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship
from .io import durable

M, EF_BUILD, EF_SEARCH, SHARD_ROWS, QUERY_BLOCK, K, SEED = 16, 64, 128, 8192, 1024, 20, 5
GROUP_BLOCKS, MOST_PARTS = 16, 20_000


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one level for all queries at once: node numbers (queries x ef, -1 where none) and
    similarities, best first. entry: queries x any, -1 where none."""
    q, n = len(queries), len(vectors)
    seen = np.zeros((q, n), bool)
    row = np.arange(q)[:, None]

    def sims(ids):
        s = np.einsum("qmd,qd->qm", vectors[np.maximum(ids, 0)], queries, optimize=False) if ids.size else np.zeros(ids.shape, np.float32)
        return np.where(ids >= 0, s, -np.inf)

    seen[row, np.maximum(entry, 0)] |= entry >= 0
    ids = np.full((q, ef), -1, np.int64)
    sim = np.full((q, ef), -np.inf, np.float32)
    e = entry.shape[1]
    take = min(e, ef)
    s = sims(entry)
    order = np.argsort(-s, 1, kind="stable")[:, :take]
    ids[:, :take], sim[:, :take] = np.take_along_axis(entry, order, 1), np.take_along_axis(s, order, 1)
    done = ids < 0
    live = np.arange(q)
    while len(live):
        # The best node of each beam that has not been expanded.
        open_ = np.where(done[live], -np.inf, sim[live])
        at = open_.argmax(1)
        has = np.isfinite(open_[np.arange(len(live)), at])
        live, at = live[has], at[has]
        if not len(live):
            break
        done[live, at] = True
        near = links[ids[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        near = np.where(fresh, near, -1)
        l2, m2 = np.nonzero(fresh)
        seen[live[l2], near[l2, m2]] = True
        s = np.full(near.shape, -np.inf, np.float32)
        if len(l2):
            s[l2, m2] = np.einsum("xd,xd->x", vectors[near[l2, m2]], queries[live[l2]])
        all_ids = np.concatenate([ids[live], near], 1)
        all_sim = np.concatenate([sim[live], s], 1)
        all_done = np.concatenate([done[live], near < 0], 1)
        order = np.argsort(-all_sim, 1, kind="stable")[:, :ef]
        ids[live] = np.take_along_axis(all_ids, order, 1)
        sim[live] = np.take_along_axis(all_sim, order, 1)
        done[live] = np.take_along_axis(all_done, order, 1) | (ids[live] < 0)
    return ids, sim


def _spread(vectors: np.ndarray, ids: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
    """Up to m neighbours of each row's candidates (best first) such that none is nearer to a chosen one than to the row;
    places left over go to the nearest others. Distances are those of unit-free augmented vectors (similarity order)."""
    q, c = ids.shape
    chosen = np.full((q, m), -1, np.int64)
    count = np.zeros(q, np.int64)
    used = np.zeros((q, c), bool)
    row = np.arange(q)
    for k in range(c):
        cand = ids[:, k]
        ok = (cand >= 0) & (count < m)
        if not ok.any():
            continue
        cv = vectors[np.maximum(cand, 0)]
        chosen_sim = np.einsum("qmd,qd->qm", vectors[np.maximum(chosen, 0)], cv)
        ok &= ~((chosen >= 0) & (chosen_sim > sim[:, [k]])).any(1)
        r = row[ok]
        chosen[r, count[r]] = cand[r]
        used[r, k] = True
        count[r] += 1
    for k in range(c):
        ok = (ids[:, k] >= 0) & ~used[:, k] & (count < m)
        r = row[ok]
        chosen[r, count[r]] = ids[r, k]
        count[r] += 1
    return chosen


class Graph:
    def __init__(self, vectors: np.ndarray, levels: list[np.ndarray], links: list[np.ndarray], entry: int):
        self.vectors, self.levels, self.links, self.entry = vectors, levels, links, entry


def build(x: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Neighbour arrays of every level (level 0 first; nodes x M or 2M, -1 where none) and the entry node."""
    x = x.astype(np.float32)
    norm2 = np.einsum("nd,nd->n", x, x)
    v = np.column_stack([x, np.sqrt(np.maximum(norm2.max() - norm2, 0))]).astype(np.float32)
    n = len(v)
    rng = np.random.Generator(np.random.PCG64(SEED))
    level = np.minimum((-np.log(1 - rng.random(n)) / np.log(M)).astype(int), 6)
    order = np.argsort(-level, kind="stable")  # higher nodes first: a level is whole before the next one needs it
    level = level[order]
    top = int(level[0])
    links = [np.full((n, M * (2 if lv == 0 else 1)), -1, np.int32) for lv in range(top + 1)]
    entry = int(order[0])
    done = 1
    while done < n:
        batch = order[done : done + max(1, min(done // 2, 512))]
        lv_of = level[done : done + len(batch)]
        at = np.full((len(batch), 1), entry, np.int64)
        for lv in range(top, -1, -1):
            ids, sim = beam(v, links[lv], v[batch], at, EF_BUILD if (lv_of >= lv).any() else 1)
            mine = np.flatnonzero(lv_of >= lv)
            if len(mine):
                width = links[lv].shape[1]
                chosen = _spread(v, ids[mine], sim[mine], M)
                links[lv][batch[mine], :M] = chosen
                _back(v, links[lv], batch[mine], chosen, width)
            at = ids[:, :1]
        done += len(batch)
    return links, entry


def _back(v: np.ndarray, links: np.ndarray, batch: np.ndarray, chosen: np.ndarray, width: int) -> None:
    """Edges back from the chosen neighbours; a full list is thinned to its best spread."""
    src = np.repeat(batch, chosen.shape[1])
    dst = chosen.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    nodes, first, counts = np.unique(dst, return_index=True, return_counts=True)
    extra = np.full((len(nodes), counts.max() if len(counts) else 0), -1, np.int64)
    if not len(nodes):
        return
    extra[np.repeat(np.arange(len(nodes)), counts), np.arange(len(dst)) - np.repeat(first, counts)] = src
    both = np.concatenate([links[nodes].astype(np.int64), extra], 1)
    sim = np.where(both >= 0, np.einsum("qmd,qd->qm", v[np.maximum(both, 0)], v[nodes]), -np.inf)
    best = np.argsort(-sim, 1, kind="stable")
    both, sim = np.take_along_axis(both, best, 1), np.take_along_axis(sim, best, 1)
    over = (both >= 0).sum(1) > width
    if both.shape[1] < width:
        both = np.pad(both, ((0, 0), (0, width - both.shape[1])), constant_values=-1)
    links[nodes[~over]] = both[~over, :width]
    if over.any():
        links[nodes[over]] = _spread(v, both[over], sim[over], width)


def search(x: np.ndarray, links: list[np.ndarray], entry: int, queries: np.ndarray, ef: int = EF_SEARCH) -> np.ndarray:
    """Node numbers near each query (queries x ef, -1 where none), best first."""
    at = np.full((len(queries), 1), entry, np.int64)
    for lv in range(len(links) - 1, 0, -1):
        ids, _ = beam(x, links[lv], queries, at, 8)
        at = ids
    return beam(x, links[0], queries, at, ef)[0]


# ---- Spark ----------------------------------------------------------------------------------------------------------


def usable(rows: DataFrame) -> DataFrame:
    """id and v of the vectors that take part. All have the commonest length."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0)
    out = rows.where(ok).where(fine).select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))
    lengths = out.groupBy(F.size("v").alias("d")).count()
    best = lengths.agg(F.max_by("d", F.struct("count", -F.col("d"))).alias("d")).first()["d"]
    return out.where(F.size("v") == F.lit(best or 0))


def index(rows: DataFrame, keep: int = K + 1) -> DataFrame:
    """shard, and the shard's nodes, their ids and its graph as flat arrays, a row a shard."""
    ship(rows.sparkSession)
    # Equal vectors, their ``keep`` smallest ids: first within a salt, so that a large group is no single task.
    near = Window.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy("id")
    some = rows.withColumn("r", F.row_number().over(near)).where(F.col("r") <= keep)
    nodes = some.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, keep).alias("ids"))
    nodes = durable(nodes, "ann-nodes")
    shards = max(1, -(-nodes.count() // SHARD_ROWS))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def graph(f: pd.DataFrame) -> pd.DataFrame:
        f = f.assign(first=[int(i[0]) for i in f.ids]).sort_values("first", ignore_index=True)
        x = np.array(f.v.tolist(), np.float64)
        links, entry = build(x)
        ids = np.full((len(f), keep), -1, np.int64)
        for k, i in enumerate(f.ids):
            ids[k, : len(i)] = i
        return pd.DataFrame({"shard": [f["shard"].iloc[0]], "n": [len(f)], "dim": [x.shape[1]], "x": [x.tobytes()], "ids": [ids.tobytes()], "links": [[a.astype(np.int32).tobytes() for a in links]], "entry": [entry]})

    return durable(nodes.groupBy("shard").applyInPandas(graph, "shard int, n int, dim int, x binary, ids binary, links array<binary>, entry int"), "ann-index")


def nearest(rows: DataFrame, is_query: Column, k: int = K, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found. is_query: over the column id."""
    spark = rows.sparkSession
    rows = durable(usable(rows), "ann-rows")
    graphs = index(rows, k + 1)
    shards = 1 + (graphs.agg(F.max("shard")).first()[0] or 0)
    asked = rows.where(is_query)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    groups = -(-blocks // GROUP_BLOCKS)
    asked = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("qs"))
    asked = asked.withColumn("group", F.floor(F.col("block") / GROUP_BLOCKS).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    sent = graphs.withColumn("block", F.lit(-1).cast("long")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # A partition holds, for each of its (shard, group) in turn, the graph and then the query blocks, which stream past it.
    parts = max(1, min(shards * groups, MOST_PARTS))
    both = sent.unionByName(asked, allowMissingColumns=True).repartition(parts, "shard", "group").sortWithinPartitions("shard", "group", "block")

    def run(batches):
        graph = of = None
        for rb in batches:
            for i in range(rb.num_rows):
                r = rb.slice(i, 1)
                at = r.column("shard")[0].as_py()
                if r.column("block")[0].as_py() < 0:
                    g = r.drop_columns(["qs"]).to_pylist()[0]
                    x = np.frombuffer(g["x"], np.float64).reshape(g["n"], g["dim"])
                    ids = np.frombuffer(g["ids"], np.int64).reshape(g["n"], k + 1)
                    links = [np.frombuffer(a, np.int32).reshape(g["n"], -1) for a in g["links"]]
                    graph, of = (x, x.astype(np.float32), ids, links, g["entry"]), at
                elif at == of:  # else no vector has this shard number
                    qid, q = (c.to_numpy() if c.type == pa.int64() else c.flatten().to_numpy() for c in r.column("qs").flatten().flatten())
                    yield from answers(graph, qid, q.reshape(len(qid), -1))

    def answers(graph, qid, q):
        x, small, ids, links, entry = graph
        for lo in range(0, len(qid), 256):
            qs, qi = q[lo : lo + 256], qid[lo : lo + 256]
            found = search(small, links, entry, qs.astype(np.float32), max(ef, k + 1))
            a, b = np.nonzero(found >= 0)
            node = found[a, b]
            score = np.einsum("xd,xd->x", x[node], qs[a])
            cand = ids[node]
            keep = (cand >= 0) & (cand != qi[a][:, None])
            ia, ib = np.nonzero(keep)
            who, vec, sc = a[ia], cand[ia, ib], score[ia]
            order = np.lexsort((vec, -sc, who))
            who, vec, sc = who[order], vec[order], sc[order]
            first = np.concatenate([[0], np.flatnonzero(np.diff(who)) + 1]) if len(who) else np.zeros(0, np.int64)
            rank = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
            best = rank < k
            yield pa.RecordBatch.from_arrays([pa.array(qi[who[best]]), pa.array(vec[best]), pa.array(sc[best])], names=["query_id", "vec_id", "score"])

    names = ["shard", "block", "n", "dim", "x", "ids", "links", "entry", "qs"]
    found = both.select(*names).mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
