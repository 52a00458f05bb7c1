"""Whole-text statistics of documents, computed for blocks of documents at a time.

``base_stats``  the six counts the quality rules are defined on.
``features``    the statistic vector of the quality classifier.
Null and empty texts have every count 0. Nothing is truncated.
"""

from __future__ import annotations

import numpy as np

from ._vec import NOT_CONTINUATION, WHITE, Block, later_copies, windows

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_stats(b: Block) -> dict[str, np.ndarray]:
    start, end, doc = b.words()
    h = b.hashes(start, end)
    out = {"n_words": np.bincount(doc, minlength=b.n)}
    out["word_chars"] = b.per_doc(NOT_CONTINUATION[b.buf] & ~WHITE[b.buf])
    out["n_symbols"] = b.per_doc(_SYMBOL[b.buf])
    ls, le, ld = b.lines()
    before, _ = later_copies(b.hashes(ls, le), ld)
    out["n_dup_lines"] = np.bincount(ld[before], minlength=b.n)
    key, at = windows(h, doc, 3)
    _, twice = later_copies(key, doc[at])
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=b.n)
    out["n_lines"] = np.bincount(ld, minlength=b.n)
    out["_words"], out["_hashes"] = (start, end, doc), h
    return {k: v.astype(np.int64) if k[0] != "_" else v for k, v in out.items()}


_CLASSES = {
    "upper": [(0x41, 0x5B)],
    "lower": [(0x61, 0x7B)],
    "digit": [(0x30, 0x3A)],
    "high": [(0xC0, 0x100)],
    "space": [(0x20, 0x21)],
    "newline": [(0x0A, 0x0B)],
    "stop": [(0x2E, 0x2F), (0x3F, 0x40)],
    "comma": [(0x2C, 0x2D)],
    "shout": [(0x21, 0x22)],
    "bar": [(0x7C, 0x7D)],
    "mark": [(0x23, 0x27), (0x2A, 0x2B)],
    "angle": [(0x3C, 0x3D), (0x3E, 0x3F)],
    "quote": [(0x22, 0x23), (0x27, 0x28)],
    "link": [(0x2F, 0x30), (0x40, 0x41), (0x5F, 0x60), (0x3A, 0x3B)],
}
_LOOKUP = np.full(256, len(_CLASSES), np.int64)
for _k, _spans in enumerate(_CLASSES.values()):
    for _a, _z in _spans:
        _LOOKUP[_a:_z] = _k

FEATURES = [
    "log_words", "log_chars", "word_len", "word_len_sd", "dup_line_share", "repeat_word_share", "symbol_share", "distinct_share",
    "same_as_previous", "line_words", "short_line_share", "top_word_share", "upper_start_share", "long_word_share",
    *(f"share_{k}" for k in _CLASSES), "share_other",
]


def features(b: Block) -> np.ndarray:
    """Documents by FEATURES, float64; shares are 0 where there is nothing to share."""
    s = base_stats(b)
    start, end, doc = s["_words"]
    h, n = s["_hashes"], np.maximum(s["n_words"], 1).astype(float)
    count = lambda flags: np.bincount(doc[flags], minlength=b.n)
    size = (end - start).astype(float)
    mean = np.bincount(doc, size, b.n) / n
    var = np.bincount(doc, size * size, b.n) / n - mean * mean
    before, _ = later_copies(h, doc)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    top = np.zeros(b.n)
    if len(h):
        order = np.lexsort((h, doc))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        at = np.flatnonzero(new)
        np.maximum.at(top, doc[order][at], np.diff(np.append(at, len(order))))
    ls, le, ld = b.lines()
    lines = np.maximum(s["n_lines"], 1).astype(float)
    lead = _LOOKUP[b.buf[start]] if len(start) else np.zeros(0, np.int64)
    size_b = np.diff(b.offs)
    owner = np.repeat(np.arange(b.n), size_b)
    kinds = len(_CLASSES) + 1
    hist = np.bincount(owner * kinds + _LOOKUP[b.buf], minlength=b.n * kinds).reshape(b.n, kinds)
    chars = np.maximum(size_b, 1)[:, None]
    cols = [
        np.log1p(s["n_words"]), np.log1p(s["word_chars"]), mean, np.sqrt(np.maximum(var, 0)), s["n_dup_lines"] / lines, s["n_repeat_words"] / n,
        s["n_symbols"] / np.maximum(s["word_chars"], 1), 1 - count(before) / n, count(same) / n, s["n_words"] / lines,
        np.bincount(ld[(le - ls) < 40], minlength=b.n) / lines, top / n, count(lead == 0) / n, count(size > 20) / n,
    ]
    return np.column_stack([*cols, hist / chars])
