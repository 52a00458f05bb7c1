"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 of ``DIM`` places, seeded by its code point. An n-gram binds its three
letters: the vectors, each rotated by its place, are multiplied place by place. A text bundles (adds) the vectors of
its trigrams; a language's prototype bundles the unit vectors of its training texts, less the mean of all prototypes'
common part. A text gets the language whose prototype has the largest cosine with it.

Letters are lower-cased code points for which ``str.isalpha`` holds; runs of anything else are one space. Texts are
read whole. ``fit`` takes a repeatable hash sample of at most about ``PER_LANGUAGE`` texts a language (a documented
bound), so a rare language keeps all its texts.

Cases: null text, or a text without a letter: ``und``, score 0; ties go to the smaller language name; without training
texts every text is ``und``; null lang is never learned.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._vec import NOT_CONTINUATION, Block
from .io import chosen, map_blocks, sample_rate

DIM, PER_LANGUAGE, SEED, UNKNOWN = 1024, 4000, 11, "und"
#: Code points beyond this share vectors, by remainder.
ALPHABET = 1 << 13


@functools.cache
def _folding() -> np.ndarray:
    """Code point (basic plane) to lower-cased letter, or 0."""
    out = np.zeros(0x10000, np.int32)
    for c in range(0x10000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@functools.cache
def _letters() -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(SEED))
    return (rng.integers(0, 2, (ALPHABET, DIM), dtype=np.int8) * 2 - 1).astype(np.int8)


def _symbols(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all documents with single spaces (0) between and around words, and each one's document."""
    try:
        cps = np.frombuffer(b.buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lens = b.per_doc(NOT_CONTINUATION[b.buf])
    except UnicodeDecodeError:
        each = [np.frombuffer(b.text(k).encode("utf-32-le"), np.uint32) for k in range(b.n)]
        cps, lens = np.concatenate(each), np.array([len(x) for x in each])
    sym = _folding()[np.minimum(cps, 0xFFFF)]
    beyond = np.flatnonzero(cps > 0xFFFF)
    if len(beyond):
        sym[beyond] = [ord(chr(c).lower()) if chr(c).isalpha() and len(chr(c).lower()) == 1 else 0 for c in cps[beyond].tolist()]
    doc = np.repeat(np.arange(b.n, dtype=np.int32), lens)
    # A space before each document, and one after the last.
    at = np.concatenate([[0], np.cumsum(lens)])
    sym = np.insert(sym, at, 0)
    doc = np.insert(doc, at, np.minimum(np.arange(b.n + 1, dtype=np.int32), max(b.n - 1, 0)))
    keep = (sym != 0) | np.concatenate([[True], sym[:-1] != 0])
    sym, doc = sym[keep], doc[keep]
    sym = np.where(sym >= ALPHABET, 1 + sym % (ALPHABET - 1), sym)
    return sym, doc


def _add(out: np.ndarray, letters: np.ndarray, code: np.ndarray, doc: np.ndarray) -> None:
    """Adds the bound vectors of trigrams to their documents' bundles, in tables of 512 documents x 4096 trigrams at most."""
    grams, which = np.unique(code, return_inverse=True)
    pair, count = np.unique(doc * len(grams) + which, return_counts=True)
    owner, gram = pair // len(grams), pair % len(grams)
    for lo in range(0, len(grams), 4096):
        g = grams[lo : lo + 4096]
        first, second, third = letters[g // ALPHABET // ALPHABET], letters[g // ALPHABET % ALPHABET], letters[g % ALPHABET]
        vec = (np.roll(first, 2, 1) * np.roll(second, 1, 1) * third).astype(np.float32)
        mine = (gram >= lo) & (gram < lo + 4096)
        rows, at = np.unique(owner[mine], return_inverse=True)
        column, n = gram[mine] - lo, count[mine]
        for part in range(0, len(rows), 512):
            inside = (at >= part) & (at < part + 512)
            table = np.zeros((min(512, len(rows) - part), len(g)), np.float32)
            table[at[inside] - part, column[inside]] = n[inside]
            out[rows[part : part + 512]] += table @ vec


def bundle(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each document (documents x DIM, float32) and whether it has a letter."""
    sym, doc = _symbols(b)
    has = np.bincount(doc[sym != 0], minlength=b.n) > 0
    out = np.zeros((b.n, DIM), np.float32)
    mid = np.flatnonzero(sym[1:-1] != 0) + 1 if len(sym) > 2 else np.zeros(0, np.int64)
    letters = _letters()
    for at in range(0, len(mid), 1 << 20):
        part = mid[at : at + (1 << 20)]
        left, here, right = (sym[part + k].astype(np.int64) for k in (-1, 0, 1))
        _add(out, letters, (left * ALPHABET + here) * ALPHABET + right, doc[part].astype(np.int64))
    return out, has


@dataclass
class Profiles:
    names: list[str]
    vectors: np.ndarray  # languages x DIM, unit length
    common: np.ndarray  # DIM

    def predict(self, b: Block) -> list:
        v, has = bundle(b)
        if not self.names:
            return [[UNKNOWN] * b.n, np.zeros(b.n)]
        norm = np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        v = v / norm - self.common
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        cos = (v @ self.vectors.T).astype(float)
        best = cos.argmax(1)
        score = np.where(has, np.clip((1 + cos[np.arange(b.n), best]) / 2, 0, 1), 0.0)
        return [[self.names[i] if ok else UNKNOWN for i, ok in zip(best, has, strict=True)], score]


def fit(docs: DataFrame, allowed: Column, bound: int = PER_LANGUAGE) -> Profiles:
    """Prototypes of every non-null lang of the rows allowed. The driver sees a vector for each task and language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & allowed)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    rate = F.lit(1.0)
    for lang, n in sorted(counts.items()):
        if n > bound:
            rate = F.when(F.col("lang") == lang, F.lit(sample_rate(n, bound))).otherwise(rate)
    cut = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED)), F.lit(1_000_000)) < (rate * 1_000_000)
    vectors = map_blocks(rows.where(cut), {"lang": F.col("lang")}, F.col("text"), _unit, [T.StructField("v", T.ArrayType(T.FloatType()))])
    sums = vectors.mapInPandas(_sum, "lang string, v array<double>")  # a row for each task and language
    total: dict[str, np.ndarray] = {}
    for r in sums.toLocalIterator():
        total[r["lang"]] = total.get(r["lang"], 0) + np.array(r["v"])
    names = sorted(total)
    p = np.array([total[k] / max(np.linalg.norm(total[k]), 1e-9) for k in names]).reshape(-1, DIM)
    common = p.mean(0) if len(p) > 1 else np.zeros(DIM)
    p = p - common
    return Profiles(names, (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)).astype(np.float32), common.astype(np.float32))


def _unit(b: Block) -> list:
    v, has = bundle(b)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return [list(v * has[:, None])]


def _sum(frames):
    import pandas as pd

    total: dict[str, np.ndarray] = {}
    for f in frames:
        for lang, part in f.groupby("lang"):
            total[lang] = total.get(lang, 0) + np.array(part.v.tolist(), float).sum(0)
    if total:
        yield pd.DataFrame({"lang": list(total), "v": [v.tolist() for v in total.values()]})


def predict(docs: DataFrame, profiles: Profiles, keep: dict[str, Column]) -> DataFrame:
    """The ``keep`` columns, lang_pred and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)  # languages x DIM numbers
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_blocks(docs, keep, F.col("text"), lambda b: sent.value.predict(b), fields)
