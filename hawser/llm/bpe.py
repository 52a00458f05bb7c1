"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pieces (matches of the tokenizer's pattern) of a block of documents are laid end to end as one linked
list of symbols. An inverted index maps the rank of every adjacent pair's merged token to the positions where the pair
stands; ranks leave a heap in order, each rank is replayed at all its positions from left to right, and only the pairs
that touch a merge are looked up again. Merges never cross a piece, so a block's result is the corpus's. A rank that
appears below the one in hand (rare) is replayed first, as a piece-by-piece encoder would do.

A piece that is itself a token is that token. Encoded pieces are kept between blocks: the last ``CACHE`` or more of those met,
2 * ``CACHE`` at most.

Cases: null or empty texts have no tokens and decode to no bytes; text is encoded as it stands, so the strings of
special tokens are ordinary text; any length; invalid bytes cannot occur in a string column's valid UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..ship import ship
from .io import small_batches

CACHE, PIECES_AT_ONCE, MEMO = 250_000, 50_000, 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.token = ranks, {i: t for t, i in ranks.items()}
        self.spelt = {str(i): t for t, i in ranks.items()}
        space = pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.split = regex.compile(space).findall
        self.byte = [ranks.get(bytes([i])) for i in range(256)]
        self.memo: dict[int, int] = {}
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def _merged(self, a: int, b: int) -> int:
        """Rank of the token that a and b make, or -1."""
        key = a << 32 | b
        r = self.memo.get(key)
        if r is None:
            r = self.memo[key] = self.ranks.get(self.token[a] + self.token[b], -1)
        return r

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece, all pieces merged together in rank order."""
        if len(self.memo) >= MEMO:  # never within a replay, which looks pairs up again
            self.memo.clear()
        sym: list[int] = []
        bounds = [0]
        for p in pieces:
            sym.extend([self.byte[c] for c in p])
            bounds.append(len(sym))
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for at in bounds[:-1]:
            if at < n:
                before[at] = -1
            if at:
                after[at - 1] = -1
        if n:
            after[n - 1] = -1
        index: dict[int, list[int]] = {}
        seen, merged = self.memo.get, self._merged
        for i in range(n):
            j = after[i]
            if j >= 0:
                r = seen(sym[i] << 32 | sym[j])
                if r is None:
                    r = merged(sym[i], sym[j])
                if r >= 0:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
        heap = list(index)
        heapify(heap)
        while heap:
            rank = heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for k, i in enumerate(places):
                j, one = after[i], sym[i]
                # A place may have been merged away, or stand twice in the list.
                if one < 0 or j < 0 or seen(one << 32 | sym[j], -1) != rank:
                    continue
                sym[i], sym[j] = rank, -1
                after[i] = nxt = after[j]
                lower = False
                if nxt >= 0:
                    before[nxt] = i
                    r = seen(rank << 32 | sym[nxt])
                    if r is None:
                        r = merged(rank, sym[nxt])
                    if r >= 0:
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            heappush(heap, r)
                        lower = r < rank
                prev = before[i]
                if prev >= 0:
                    r = seen(sym[prev] << 32 | rank)
                    if r is None:
                        r = merged(sym[prev], rank)
                    if r >= 0:
                        if r in index:
                            index[r].append(prev)
                        else:
                            index[r] = [prev]
                            heappush(heap, r)
                        lower |= r < rank
                if lower:
                    if rank not in index:
                        heappush(heap, rank)
                    index.setdefault(rank, []).extend(places[k + 1 :])
                    break
        return [[s for s in sym[a:b] if s >= 0] for a, b in zip(bounds, bounds[1:], strict=False)]

    def learn(self, texts: list[list[str]]) -> None:
        """Encodes the pieces not known yet: their ids, in decimal, joined by commas."""
        known, older, ranks = self.known, self.older, self.ranks
        new: list[str] = []
        for pieces in texts:
            for p in set(pieces):
                if p not in known:
                    if p in older:
                        known[p] = older[p]
                        continue
                    whole = ranks.get(p.encode())
                    known[p] = "" if whole is None else str(whole)
                    if whole is None:
                        new.append(p)
        for lo in range(0, len(new), PIECES_AT_ONCE):
            part = new[lo : lo + PIECES_AT_ONCE]
            for p, ids in zip(part, self.replay([p.encode() for p in part]), strict=True):
                known[p] = ",".join(map(str, ids))

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text, in decimal, joined by commas."""
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}
        pieces = [self.split(t) for t in texts]
        self.learn(pieces)
        at = self.known.__getitem__
        return [",".join(map(at, p)) for p in pieces]

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.spelt.__getitem__, ids.split(","))) if ids else b""


_made: dict[int, Encoder] = {}


def _encoder(sent, pattern: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    key = sent.id if hasattr(sent, "id") else id(sent)
    key = hash((key, len(sent.value), pattern))
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(sent.value, pattern)
    return _made[key]


def _texts(rb: pa.RecordBatch, column: int, limit: int = 1 << 21):
    """Runs of texts of about ``limit`` characters; null counts as empty."""
    part: list[str] = []
    size = 0
    for s in rb.column(column):
        t = s.as_py() or ""
        part.append(t)
        size += len(t)
        if size > limit:
            yield part
            part, size = [], 0
    yield part


def _mapped(df: DataFrame, keep: dict[str, Column], text: Column, ranks: dict[bytes, int], pattern: str, make, fields: list[T.StructField]) -> DataFrame:
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    src = df.select(*[c.alias(k) for k, c in keep.items()], text.cast("string").alias("__text"))
    kept, names = list(keep), [f.name for f in fields]
    schema = T.StructType([*[src.schema[k] for k in kept], *fields])
    sent = df.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary: about 50,000 tokens

    def run(batches):
        enc = _encoder(sent, pattern)
        kinds = to_arrow_schema(T.StructType(fields))
        for rb in batches:
            rows = [r for part in _texts(rb, len(kept)) for r in make(enc, part)]
            cols = [pa.array([r[i] for r in rows], kinds.field(i).type) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*(rb.column(i) for i in range(len(kept))), *cols], names=[*kept, *names])

    return src.mapInArrow(run, schema)


def _ids(enc: Encoder, texts: list[str]):
    for s in enc.encode(texts):
        ids = np.fromstring(s, np.int32, sep=",") if s else np.zeros(0, np.int32)
        yield len(ids), ids


def _digests(enc: Encoder, texts: list[str]):
    for s in enc.encode(texts):
        yield s.count(",") + 1 if s else 0, hashlib.sha256(s.encode()).hexdigest(), hashlib.sha256(enc.decode(s)).hexdigest()


def encode(docs: DataFrame, keep: dict[str, Column], ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """The ``keep`` columns, n_tokens and ids (array of int) of every whole text."""
    return _mapped(docs, keep, F.col("text"), ranks, pattern, _ids, [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def _round_trip(enc: Encoder, texts: list[str]):
    for s in enc.encode(texts):
        ids = np.fromstring(s, np.int32, sep=",") if s else np.zeros(0, np.int32)
        yield len(ids), ids, hashlib.sha256(enc.decode(s)).hexdigest()


def round_trip(docs: DataFrame, keep: dict[str, Column], ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """The ``keep`` columns, n_tokens, ids, and the digest of the bytes that the ids decode to."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(docs, keep, F.col("text"), ranks, pattern, _round_trip, fields)


def digests(docs: DataFrame, keep: dict[str, Column], ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """The ``keep`` columns, n_tokens, and the digests of the ids and of the bytes that these ids decode to."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(docs, keep, F.col("text"), ranks, pattern, _digests, fields)


def decode(encoded: DataFrame, keep: dict[str, Column], ranks: dict[bytes, int]) -> DataFrame:
    """The ``keep`` columns and the bytes that the column ``ids`` decodes to."""
    fields = [T.StructField("bytes", T.BinaryType())]
    return _mapped(encoded, keep, F.array_join(F.col("ids"), ","), ranks, "", lambda enc, part: [(enc.decode(s),) for s in part], fields)
