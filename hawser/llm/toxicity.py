"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is cut into clauses at ``. ! ? ; :`` and line ends. In a clause, a cascade of deterministic transducers (their
composition) rewrites the token classes and their weights from left to right:

1. lexical     a token becomes INSULT (with its weight), HARM, INTENT, TARGET, NEGATION, REPORT or OTHER;
2. threat      INTENT with HARM within ``REACH`` tokens makes THREAT; HARM alone weighs nothing;
3. target      INSULT or THREAT within ``REACH`` tokens of a TARGET weighs TARGET_FACTOR times as much;
4. negation    INSULT or THREAT within ``REACH`` tokens after a NEGATION weighs NEGATION_FACTOR times as much;
5. reported    after REPORT, the rest of the clause weighs REPORT_FACTOR times as much.

A clause scores the sum of the weights left; a document's score is a logistic function of its clauses' scores alone: of their
sum, the largest, the sum a hundred tokens, and the sum of s / (1 + s), a count of matched clauses in which a negated or
reported one counts less. Whatever lowers a clause's score lowers all four. The
insult transducer's vocabulary (words, and stems of 4 to 7 bytes) and weights are learned from labelled texts: the
lower bound of the log odds that a token marks toxic texts. Half the sample learns the vocabulary, the other half the
logistic function (the whole sample learns both where a half has under SPLIT_FROM toxic texts). The sample has at most about ``SAMPLE`` labelled rows, a documented bound; near copies of
one label within it (those that share the ``MINIMA`` smallest hashes of their word shingles) count once, so that no single
copied text makes vocabulary.

Cases: null and empty texts have no clause and get the score of a text without a match; no labelled rows: only the
fixed vocabulary and default weights are used; repeated rows each get a row; ties cannot arise.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._vec import Block
from .io import chosen, durable, map_blocks
from .quality_classifier import labelled

SAMPLE, REACH = 24_000, 4
SHINGLE, MINIMA = 3, 4
STEMS = (4, 5, 6, 7)
TARGET_FACTOR, NEGATION_FACTOR, REPORT_FACTOR, THREAT_WEIGHT, SEED_WEIGHT = 1.5, 0.25, 0.5, 4.0, 2.0
LEAST_LOG_ODDS, LEAST_COUNT, LEAST_SHARE, VOCABULARY, SPLIT_FROM = 2.0, 4, 0.01, 2000, 100

#: The vocabulary that is not learned.
SEED_INSULTS = "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown imbecile dimwit vermin filth".split()
HARM = (
    "kill kills killed killing hurt hurts hurting beat beating stab stabbing shoot shooting destroy strangle murder crush burn "
    "hang choke poison break smash punch kick slap bomb attack harm die bleed suffer perish vanish rot "
    "töten umbringen schlagen verletzen sterben verbrennen tuer frapper blesser mourir brûler matar golpear herir morir quemar"
).split()
INTENT = (
    "will gonna shall should must want wants going gotta deserve deserves let ill im hope wish may would could plan swear promise "
    "werde wirst wird sollst soll musst muss will hoffe vais va vas veux dois doit devrait voy vas va quiero debes debe deberías ojalá"
).split()
TARGET = (
    "you your yours youre yourself u ur he his she her hers him they them their theirs these those this that everyone everybody "
    "anyone people guys folks ya yall du dich dir dein deine ihr euch euer sie er tu toi te ton ta vous votre vos il elle ils elles "
    "tú ti usted ustedes vosotros él ella ellos ellas"
).split()
NEGATION = "not never no isnt arent dont doesnt nicht kein keine pas jamais nunca ni".split()
REPORT = "said says called calls claimed claims wrote quoted told asked sagte dit dijo".split()
CLASSES = {"HARM": HARM, "INTENT": INTENT, "TARGET": TARGET, "NEGATION": NEGATION, "REPORT": REPORT}
OTHER, INSULT, THREAT = 0, 6, 7

_INSIDE = np.zeros(256, bool)
_INSIDE[0x61:0x7B] = True
_INSIDE[0x80:] = True
_CUT = np.zeros(256, bool)
_CUT[list(b".!?;:\n")] = True


def lowered(b: Block) -> Block:
    parts = [b.text(k).lower().replace("'", "").replace("’", "").encode() for k in range(b.n)]
    return Block(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]))


def hashes_of(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
    return Block(np.frombuffer(b"".join(raw), np.uint8), offs).hashes(offs[:-1], offs[1:])


def tokens(b: Block):
    """Start, end, document of every letter run of a lowered block, and its hashes: whole word, then each stem."""
    start, end = b.runs(_INSIDE[b.buf])
    whole = b.hashes(start, end)
    # A stem is another token than the word that is spelt like it.
    stems = [np.where(end - start > n, b.hashes(start, np.minimum(start + n, end)) ^ np.uint64(n), np.uint64(0)) for n in STEMS]
    return start, end, b.doc_of(start), [whole, *stems]


# ---- transducers: state machines over (class, weight); each maps a clause to a clause -------------------------------


def threat(clause: list[tuple[int, float]]) -> list[tuple[int, float]]:
    out, since = [], REACH + 1
    for kind, w in clause:
        since = 0 if kind == 2 else since + 1
        out.append((THREAT, THREAT_WEIGHT) if kind == 1 and since <= REACH else (kind, w))
    return out


def target(clause: list[tuple[int, float]]) -> list[tuple[int, float]]:
    def near(seq):
        since, flags = REACH + 1, []
        for kind, _ in seq:
            since = 0 if kind == 3 else since + 1
            flags.append(since <= REACH)
        return flags

    before, after = near(clause), near(clause[::-1])[::-1]
    return [(k, w * TARGET_FACTOR) if k >= INSULT and (x or y) else (k, w) for (k, w), x, y in zip(clause, before, after, strict=True)]


def negation(clause: list[tuple[int, float]]) -> list[tuple[int, float]]:
    out, left = [], 0
    for kind, w in clause:
        if kind == 4:
            left = REACH + 1
        left -= 1
        out.append((kind, w * NEGATION_FACTOR) if kind >= INSULT and left >= 0 else (kind, w))
        left = max(left, -1)
    return out


def reported(clause: list[tuple[int, float]]) -> list[tuple[int, float]]:
    out, seen = [], False
    for kind, w in clause:
        seen |= kind == 5
        out.append((kind, w * REPORT_FACTOR) if kind >= INSULT and seen else (kind, w))
    return out


def clause_score(clause: list[tuple[int, float]]) -> float:
    for step in (threat, target, negation, reported):
        clause = step(clause)
    return sum(w for k, w in clause if k >= INSULT)


# ---- the grammar ---------------------------------------------------------------------------------------------------


@dataclass
class Grammar:
    vocabulary: dict[int, float] = field(default_factory=dict)  # token hash -> weight
    logistic: np.ndarray = field(default_factory=lambda: np.array([-4.0, 1.5, 0.6, 1.0, 0.3]))

    def __post_init__(self):
        seeds = {int(h): SEED_WEIGHT for h in hashes_of(SEED_INSULTS)}
        words = seeds | self.vocabulary
        self.key = np.array(sorted(words), np.uint64)
        self.weight = np.array([words[int(k)] for k in self.key])
        kinds = {int(h): 1 + i for i, ws in enumerate(CLASSES.values()) for h in hashes_of(ws)}
        self.kind_key = np.array(sorted(kinds), np.uint64)
        self.kind = np.array([kinds[int(k)] for k in self.kind_key])

    def clauses(self, b: Block) -> np.ndarray:
        """Documents x (log of the sum of clause scores, the largest, log of the sum of s / (1 + s), sum per 100 tokens)."""
        b = lowered(b)
        start, _, doc, hs = tokens(b)
        w = np.zeros(len(start))
        for h in hs:
            at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
            w = np.maximum(w, np.where(self.key[at] == h, self.weight[at], 0))
        at = np.minimum(np.searchsorted(self.kind_key, hs[0]), len(self.kind_key) - 1)
        kind = np.where(self.kind_key[at] == hs[0], self.kind[at], OTHER)
        kind = np.where(w > 0, INSULT, kind)
        out = np.zeros((b.n, 4))
        # Only clauses with an insult, or with a word of harm, can score.
        clause = np.cumsum(_CUT[b.buf])[start] if len(start) else np.zeros(0, np.int64)
        live = np.flatnonzero((kind == INSULT) | (kind == 1))
        if not len(live):
            return out
        new = np.ones(len(start), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (clause[1:] != clause[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start))
        total, best, soft = np.zeros(b.n), np.zeros(b.n), np.zeros(b.n)
        for c in np.unique(np.searchsorted(first, live, side="right") - 1):
            lo, hi = first[c], last[c]
            s = clause_score(list(zip(kind[lo:hi].tolist(), w[lo:hi].tolist(), strict=True)))
            if s > 0:
                d = doc[lo]
                total[d] += s
                best[d] = max(best[d], s)
                soft[d] += s / (1 + s)
        return np.column_stack([np.log1p(total), best, np.log1p(soft), 100 * total / np.maximum(np.bincount(doc, minlength=b.n), 1)])

    def score(self, b: Block) -> np.ndarray:
        x = self.clauses(b)
        return 1 / (1 + np.exp(-np.clip(self.logistic[0] + x @ self.logistic[1:], -30, 30)))


def _counts(b: Block, y: np.ndarray):
    """Distinct token hashes of each document, counted by label."""
    b = lowered(b)
    _, _, doc, hs = tokens(b)
    h, d = np.concatenate(hs), np.tile(doc, len(hs))
    h, d = h[h != 0], d[h != 0]
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    key, at = np.unique(h, return_inverse=True)
    pos = np.bincount(at, y[d], len(key))
    return key.view(np.int64), pos.astype(np.int64), np.bincount(at, minlength=len(key)) - pos.astype(np.int64)


def _token_counts(batches):
    import pyarrow as pa

    from ._vec import blocks

    for rb in batches:
        y = rb.column(0).to_numpy(zero_copy_only=False).astype(float)
        for at, b in blocks(rb.column(1)):
            key, pos, neg = _counts(b, y[at : at + b.n])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(pos), pa.array(neg)], names=["h", "pos", "neg"])


def _copies_once(rows: DataFrame) -> DataFrame:
    """One row of each group of near copies: same label, same MINIMA smallest hashes of SHINGLE-word shingles."""
    words = F.split(F.coalesce("text", F.lit("")), r"\s+")
    shingle = lambda k: F.xxhash64(F.concat_ws(" ", F.slice("words", k, SHINGLE)))
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (SHINGLE - 1), F.lit(1))), shingle)
    rows = rows.withColumn("words", words).withColumn("sketch", F.slice(F.array_sort(F.array_distinct(hashes)), 1, MINIMA)).drop("words")
    one = rows.groupBy("sketch", "y").agg(F.min("doc_id").alias("doc_id"))
    return rows.join(one, ["sketch", "y", "doc_id"], "left_semi")


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, bound: int = SAMPLE) -> Grammar:
    rows = labelled(docs, labels, "toxic", allowed, bound).where("y is not null")
    rows = durable(_copies_once(rows).select("doc_id", F.col("y").cast("int").alias("y"), F.coalesce("text", F.lit("")).alias("text")), "toxic")
    half = chosen(F.col("doc_id"), 0.5, seed=13)
    n = {(r["half"], r["y"]): r["count"] for r in rows.groupBy(half.alias("half"), "y").count().collect()}
    split = n.get((True, 1), 0) >= SPLIT_FROM and n.get((False, 1), 0) > 0
    words, rest = (half, ~half) if split else (F.lit(True), F.lit(True))
    pos_n, neg_n = (sum(v for (h, y), v in n.items() if y == k and (h or not split)) for k in (1, 0))
    if not pos_n or not neg_n:
        return Grammar()
    counted = rows.where(words).select("y", "text").mapInArrow(_token_counts, "h long, pos long, neg long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    least = max(LEAST_COUNT, LEAST_SHARE * pos_n)
    pos, neg = F.col("pos") + 0.5, F.col("neg") + 0.5
    odds = F.log(pos / (pos_n + 1.0)) - F.log(neg / (neg_n + 1.0)) - F.sqrt(1 / pos + 1 / neg)
    top = counted.where(F.col("pos") >= least).withColumn("w", odds).where(F.col("w") >= LEAST_LOG_ODDS).orderBy(F.desc("w"), "h").limit(VOCABULARY).collect()
    g = Grammar({int(np.int64(r["h"]).view(np.uint64)): float(r["w"]) for r in top})
    sent = docs.sparkSession.sparkContext.broadcast(g)
    seen = map_blocks(rows.where(rest), {"doc_id": F.col("doc_id"), "y": F.col("y")}, F.col("text"), lambda b: [list(sent.value.clauses(b))], [T.StructField("x", T.ArrayType(T.DoubleType()))])
    got = seen.toPandas().sort_values("doc_id")
    g.logistic = _logistic(np.array(got.x.tolist(), float).reshape(-1, 4), got.y.to_numpy(float), g.logistic)
    return g


def _logistic(x: np.ndarray, y: np.ndarray, default: np.ndarray) -> np.ndarray:
    """Penalised logistic regression by Newton steps; coefficients on the raw features, none below 0."""
    if len(np.unique(y)) < 2:
        return default
    scale = np.maximum(x.std(0), 1e-6)
    a = np.column_stack([np.ones(len(x)), x / scale])
    w, ridge = np.zeros(a.shape[1]), np.diag([1e-6, *[1.0] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p) + 1e-9)) @ a + ridge, a.T @ (y - p) - ridge @ w)
        w = w + step
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([[w[0]], w[1:] / scale])


def score(docs: DataFrame, grammar: Grammar, keep: dict[str, Column], name: str = "score") -> DataFrame:
    """The ``keep`` columns and the score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(grammar)  # VOCABULARY weights at most
    return map_blocks(docs, keep, F.col("text"), lambda b: [sent.value.score(b)], [T.StructField(name, T.DoubleType())])
