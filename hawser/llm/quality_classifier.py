"""Quality classifier: histogram gradient-boosted trees over document statistics.

``fit`` learns from at most about ``SAMPLE`` labelled rows (a repeatable hash sample, a documented bound), on the
driver: features are cut into ``BINS`` quantile bins, and every level of a tree is grown from gradient histograms.
The model is four flat arrays (a complete binary tree each, children of i at 2i+1 and 2i+2). ``score`` walks all
trees for a block of documents at once, one numpy gather a level.

Cases: null and empty texts have the zero vector and get the score the trees give it; without labelled rows, or with
one class only, the score is the smoothed share of label 1; repeated rows each get a row; null or repeated labels of
a document: nulls are ignored, the largest counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .io import chosen, map_blocks, sample_rate
from .text_stats import FEATURES, features

SAMPLE, BINS, TREES, DEPTH, RATE, L2, MIN_CHILD = 20_000, 64, 60, 4, 0.15, 1.0, 5.0


@dataclass
class Model:
    feature: np.ndarray  # trees x nodes
    cut: np.ndarray
    value: np.ndarray
    base: float
    depth: int = DEPTH

    def raw(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros((len(x), len(self.feature)), np.int64)
        if not len(self.feature):
            return np.full(len(x), self.base)
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.cut[tree, node])
        return self.base + self.value[tree, node].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Model:
    """Boosted trees for the logistic loss. y: 0 or 1."""
    nodes = 2 ** (depth + 1) - 1
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    none = Model(np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes)), base, depth)
    if len(np.unique(y)) < 2:
        return none
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    d, raw = x.shape[1], np.full(len(y), base)
    feats, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feat, cut, value = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            lo, n = 2**level - 1, 2**level
            local = node - lo
            best, pick = np.zeros(n), [None] * n
            tg, th = np.bincount(local, g, n), np.bincount(local, h, n)
            for f in range(d):
                at = local * BINS + binned[:, f]
                gl = np.bincount(at, g, n * BINS).reshape(n, BINS).cumsum(1)
                hl = np.bincount(at, h, n * BINS).reshape(n, BINS).cumsum(1)
                gr, hr = tg[:, None] - gl, th[:, None] - hl
                gain = gl**2 / (hl + L2) + gr**2 / (hr + L2) - (tg**2 / (th + L2))[:, None]
                gain[(hl < MIN_CHILD * 0.05) | (hr < MIN_CHILD * 0.05)] = 0
                gain[:, len(edges[f]) :] = 0
                k = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(n), k] > best + 1e-9):
                    best[i], pick[i] = gain[i, k[i]], (f, k[i])
            for i, hit in enumerate(pick):
                if hit:
                    feat[lo + i], cut[lo + i] = hit[0], edges[hit[0]][hit[1]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feat[node]] > cut[node])
        lo, n = 2**depth - 1, 2**depth
        value[lo:] = -RATE * np.bincount(node - lo, g, n) / (np.bincount(node - lo, h, n) + L2)
        raw = raw + value[node]
        feats.append(feat), cuts.append(cut), values.append(value)
    return Model(np.array(feats), np.array(cuts), np.array(values), base, depth)


def labelled(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, bound: int) -> DataFrame:
    """doc_id, text, y of a repeatable sample of about ``bound`` labelled rows whose fold is allowed.

    The sampled label rows are broadcast: about ``bound`` pairs of numbers, whatever the input.
    """
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.max(label).alias("y"))
    y = y.where(chosen(F.col("doc_id"), sample_rate(y.count(), bound)))
    return docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, bound: int = SAMPLE) -> Model:
    rows = labelled(docs, labels, "quality", allowed, bound)
    vectors = map_blocks(rows, {"doc_id": F.col("doc_id"), "y": F.col("y").cast("int")}, F.col("text"), lambda b: [list(features(b))], [T.StructField("x", T.ArrayType(T.DoubleType()))])
    got = vectors.toPandas()  # about ``bound`` rows of len(FEATURES) numbers
    got = got.assign(k=[tuple(x) for x in got.x]).sort_values(["doc_id", "k"])
    x = np.array(got.x.tolist(), float).reshape(-1, len(FEATURES))
    return train(x, got.y.to_numpy(float))


def score(docs: DataFrame, model: Model, keep: dict[str, Column], name: str = "score") -> DataFrame:
    """The ``keep`` columns and the score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # TREES x 2^(DEPTH+1) numbers
    return map_blocks(docs, keep, F.col("text"), lambda b: [sent.value.score(features(b))], [T.StructField(name, T.DoubleType())])
