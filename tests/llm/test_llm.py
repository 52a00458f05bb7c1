"""The training-data operators: brute-force versions, round trips, held-out accuracy, and the edge cases of every one.

The edge table has null, empty, wordless and very long texts, ties, repeated rows, nulls in every column, and extra
columns whose names clash with the results'."""

import hashlib
import itertools
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hawser.llm import bagminhash, bpe, hnsw, language_id, mixing, pii, quality_classifier, quality_rules, queries, toxicity, warc
from hawser.llm._vec import Block, blocks
from hawser.llm.text_stats import FEATURES, base_stats, features

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, __size int, class_id int"


def block(*texts):
    raw = [t.encode() for t in texts]
    return Block(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


def make(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "x", 1, 2) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def edge(spark):
    rng = random.Random(3)
    words = ["alpha", "béta", "gamma", "delta", "omega", "straße", "niño", "été"]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    rows = [(1, None, "en", "s0"), (2, "", "en", None), (3, "  \n\t ", None, "s1"), (4, long, "en", "s0"), (5, "one two three", "fr", "s0"), (5, "one two three", "fr", "s0"), (6, "one two three", None, "s0"), (None, "no id here at all", "en", "s0"), (7, "a" * 5000, "de", "s1"), (8, "𝔘𝔫𝔦 🙂  x\r\ny", "de", None), (9, "1234 !!! ###", "de", "s1")]
    return make(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(10)] + [(4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def random_texts(n, seed):
    rng = random.Random(seed)
    pool = ["a", "bb", "ccc", "dé", "e", "f.", "g\n", "h\t", "##", "  "]
    return [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


# ---- statistics -----------------------------------------------------------------------------------------------------


def slow_stats(t):
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_base_stats_brute_force():
    texts = [*random_texts(300, 1), "", "x", "é é é é", "a b c a b c\na b c a b c\n"]
    s = base_stats(block(*texts))
    got = list(zip(*(s[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
    assert got == [slow_stats(t) for t in texts]


def test_blocks_do_not_change_results():
    import pyarrow as pa

    texts = [*random_texts(100, 2), None, ""]
    whole = features(next(iter(blocks(pa.array(texts))))[1])
    parts = np.vstack([features(b) for _, b in blocks(pa.array(texts), 50)])
    assert np.array_equal(whole, parts) and whole.shape[1] == len(FEATURES) and np.isfinite(whole).all()


# ---- op1 ------------------------------------------------------------------------------------------------------------


def test_toxic_grammar():
    I = toxicity.INSULT
    base = toxicity.clause_score([(0, 0.0), (I, 2.0)])
    assert base == 2.0
    assert toxicity.clause_score([(3, 0.0), (I, 2.0)]) == 2.0 * toxicity.TARGET_FACTOR
    assert toxicity.clause_score([(4, 0.0), (I, 2.0)]) == 2.0 * toxicity.NEGATION_FACTOR
    assert toxicity.clause_score([(5, 0.0), (I, 2.0)]) == 2.0 * toxicity.REPORT_FACTOR
    assert toxicity.clause_score([(2, 0.0), (1, 0.0)]) == toxicity.THREAT_WEIGHT and toxicity.clause_score([(1, 0.0)]) == 0
    g = toxicity.Grammar()
    s = g.score(block("you are an idiot and a moron. you pathetic loser!", "you are not an idiot", "he said: fine", ""))
    assert s[0] > s[1] > s[2] == s[3]


def slow_clauses(g, t):
    t = t.lower().replace("'", "").replace("’", "")
    kinds = {w: 1 + i for i, ws in enumerate(toxicity.CLASSES.values()) for w in ws}
    seeds = set(toxicity.SEED_INSULTS)
    scores, n = [], 0
    for part in re.split(r"[.!?;:\n]", t):
        words = re.findall(r"[a-z\x80-\U0010ffff]+", part)
        n += len(words)
        scores.append(toxicity.clause_score([(toxicity.INSULT, toxicity.SEED_WEIGHT) if w in seeds else (kinds.get(w, 0), 0.0) for w in words]))
    return [np.log1p(sum(scores)), max(scores), np.log1p(sum(x / (1 + x) for x in scores)), 100 * sum(scores) / max(n, 1)]


def test_toxic_clauses_brute_force():
    rng, g = random.Random(22), toxicity.Grammar()
    words = [*toxicity.SEED_INSULTS[:4], "kill", "will", "you", "not", "said", "house", "straße", "It's", "!", ".", "\n", "12", ":", "never", "they"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(400)] + ["", "x"]
    assert np.allclose(g.clauses(block(*texts)), [slow_clauses(g, t) for t in texts])


def test_negation_and_report_lower_every_input():
    x = toxicity.Grammar().clauses(block("well you are an idiot", "you are not an idiot", "he said you idiot fool", "well he is you idiot fool", "i will kill you", "i will not kill you"))
    assert (x[0] > x[1]).all() and (x[3] > x[2]).all() and (x[4] > 0).all() and (x[5] < x[4]).all()


@needs_data
def test_toxicity_held_out(spark):
    lab = spark.read.parquet(f"{DATA}/../sf0.01/labels.parquet").toPandas()
    p = queries.op1_toxicity(spark, f"{DATA}/../sf0.01").toPandas().merge(lab, on="doc_id")
    p = p[p.held_out & p.toxic.notna()]
    assert (p.predicted == p.toxic).mean() >= 0.9


def test_toxicity_edges(spark, edge, empty, labels):
    g = toxicity.fit(edge, labels, F.lit(True))
    p = toxicity.score(edge, g, {"doc_id": F.col("doc_id")}).toPandas()
    assert len(p) == 11 and p.score.between(0, 1).all()
    assert toxicity.score(empty, toxicity.fit(empty, labels, F.lit(True)), {"doc_id": F.col("doc_id")}).count() == 0


def test_toxicity_learns_from_distinct_texts_that_share_words(spark):
    rng = random.Random(17)
    common = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(40)]

    def text(word):
        w = [*rng.sample(common, len(common)), word]
        return " ".join(rng.sample(w, len(w)))

    rows = [(i, text("zorgle" if i % 4 == 0 else "house"), "en", "s") for i in range(240)]
    copied = text("vlimp")
    rows += [(1000 + i, copied, "en", "s") for i in range(60)]
    y = spark.createDataFrame([(r[0], 1, int(r[0] >= 1000 or r[0] % 4 == 0)) for r in rows], "doc_id long, quality int, toxic int")
    g = toxicity.fit(make(spark, rows), y, F.lit(True))
    s = g.score(block("you zorgle", "you house", "you vlimp"))
    assert s[0] > s[1] == s[2]


# ---- op2 ------------------------------------------------------------------------------------------------------------


def grams(t):
    w = WORD.findall(t or "")
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    i = sum((a & b).values())
    return i / max(1, sum(a.values()) + sum(b.values()) - i)


def test_bagminhash_is_unbiased():
    rng = random.Random(5)
    pairs = []
    for _ in range(60):
        a = [rng.choice("abcdefgh") for _ in range(60)]
        b = [c if rng.random() < 0.95 else "z" for c in a]
        pairs += [" ".join(a), " ".join(b)]
    blk = block(*pairs)
    sig = bagminhash.signatures(blk.n, *bagminhash.shingles(blk))
    assert np.isfinite(sig).all()
    est = [(sig[k] == sig[k + 1]).mean() for k in range(0, len(pairs), 2)]
    true = [jaccard(grams(pairs[k]), grams(pairs[k + 1])) for k in range(0, len(pairs), 2)]
    assert abs(np.mean(est) - np.mean(true)) < 0.02
    heavy = bagminhash.signatures(2, np.array([0, 0, 1, 1]), np.array([1, 2, 1, 2], np.uint64), np.array([9, 3, 5, 3]))
    assert abs((heavy[0] == heavy[1]).mean() - 8 / 12) < 0.15


def test_near_duplicates_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(words) for _ in range(60)]
    docs = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(40, 200))]
        for _ in range(rng.randrange(1, 9)):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            docs.append(" ".join(t))
        docs.append(" ".join(passage + [rng.choice(words) for _ in range(80)]))
    docs += [docs[0]] * 5 + ["tiny text", "tiny text", "tiny  text"]
    p = bagminhash.classes(make(spark, [(i, t, "en", "s") for i, t in enumerate(docs)])).toPandas()
    assert dict(zip(p.doc_id, p.class_id, strict=True)) == brute_classes(docs)
    same = {}
    assert dict(zip(p.doc_id, p.rep_id, strict=True)) == {i: same.setdefault(frozenset(grams(t).items()) or i, i) for i, t in enumerate(docs)}


def brute_classes(docs):
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    gs = [grams(t) for t in docs]
    for a, b in itertools.combinations(range(len(docs)), 2):
        if jaccard(gs[a], gs[b]) >= 0.8 and find(a) != find(b):
            up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in range(len(docs))}


def test_large_groups_of_near_copies_brute_force(spark, monkeypatch):
    """Near copies around one text, chains of edits that no hub joins, and texts that share a passage, in small blocks."""
    rng = random.Random(18)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(120)]

    def edited(t, k):
        t = list(t)
        for _ in range(k):
            t[rng.randrange(len(t))] = rng.choice(words)
        return t

    docs = [edited(base, rng.randrange(0, 9)) for _ in range(160)]
    chain = [rng.choice(words) for _ in range(150)]
    for _ in range(60):
        chain = edited(chain, 2)
        docs.append(chain)
    passage = [rng.choice(words) for _ in range(80)]
    docs += [passage + [rng.choice(words) for _ in range(rng.randrange(15, 40))] for _ in range(120)]
    docs = [" ".join(t) for t in docs]
    rng.shuffle(docs)
    monkeypatch.setattr(bagminhash, "BLOCK", 16)
    monkeypatch.setattr(bagminhash, "HUB_EDGES", 8)
    p = bagminhash.classes(make(spark, [(i, t, "en", "s") for i, t in enumerate(docs)])).toPandas()
    assert dict(zip(p.doc_id, p.class_id, strict=True)) == brute_classes(docs)


def test_overlaps_of_sets():
    rng = np.random.default_rng(19)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 60))) for _ in range(30)]
    got = bagminhash.overlaps(np.array([len(x) for x in sets]), np.concatenate(sets))
    assert all(got[a, b] == len(np.intersect1d(sets[a], sets[b])) for a, b in itertools.combinations(range(30), 2))


def test_doc_ids_of_several_texts_stay(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = make(spark, [(1, one, "en", "s"), (1, two, "en", "s"), (1, one, "en", "s"), (2, two, "en", "s"), (3, one, "en", "s")])
    assert Counter(r["text"] for r in bagminhash.keep_one(df).collect()) == {one: 1, two: 1}


def test_near_duplicates_edges(spark, edge, empty):
    p = bagminhash.classes(edge).toPandas()
    got = Counter(zip(p.doc_id.fillna(-1).astype(int), p.class_id.fillna(-1).astype(int), strict=True))
    assert got[(6, 5)] == 1 and got[(5, 5)] == 2 and got[(-1, -1)] == 1 and got[(1, 1)] == got[(2, 2)] == got[(3, 3)] == 1 and len(p) == 11
    kept = bagminhash.keep_one(edge)
    assert kept.columns == edge.columns and kept.count() == 9
    assert bagminhash.classes(empty).count() == 0


# ---- op3 ------------------------------------------------------------------------------------------------------------


def test_quality_rules(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(80, 300))), "en", "s") for i in range(400)]
    rows += [(1000, " ".join("#$%&*" for _ in range(200)), "en", "s"), (1001, "a b c " * 60, "en", "s"), (1002, "short", "en", "s"), (1003, None, None, None)]
    p = quality_rules.apply(make(spark, rows)).toPandas().set_index("doc_id")
    assert p.kept.loc[list(range(400))].mean() > 0.99 and not p.kept[[1000, 1001, 1002, 1003]].any()
    assert p.base_failed[[1001, 1002, 1003]].all() and list(p.n_words[[1002, 1003]]) == [1, 0]


def test_mcd_ignores_contamination(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(3, 1, (900, 5))
    x[:200] += 40
    z = spark.createDataFrame(pd.DataFrame(x, columns=quality_rules.DIMS)).withColumn("g", F.lit("a"))
    m = quality_rules.estimates(z).first()
    assert np.allclose(m["m"], 3, atol=0.3)


def test_quality_rules_third_of_group_is_outlying_copies(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(80, 300))), "en", "s") for i in range(600)]
    copy = " ".join(word() + "#" * rng.randrange(2, 4) for _ in range(150))
    rows += [(1000 + i, copy, "en", "s") for i in range(300)]
    p = quality_rules.apply(make(spark, rows)).toPandas().set_index("doc_id")
    assert not p.base_failed.any() and not p.kept[list(range(1000, 1300))].any()
    assert p.kept[list(range(600))].mean() > 0.99


def test_quality_rules_repetition_below_base_thresholds(spark):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    line = lambda: " ".join(word() for _ in range(10))
    rows = [(i, "\n".join(line() for _ in range(rng.randrange(8, 30))), "en", "s") for i in range(500)]
    for i in range(5):  # 19 distinct lines, one of them 9 times: 8 of 27 lines, 90 of 270 words
        once = [line() for _ in range(19)]
        rows.append((1000 + i, "\n".join(once + once[:1] * 8), "en", "s"))
    p = quality_rules.apply(make(spark, rows)).toPandas().set_index("doc_id")
    far = list(range(1000, 1005))
    assert not p.base_failed[far].any() and not p.kept[far].any()
    assert p.kept[list(range(500))].mean() > 0.99


@pytest.mark.parametrize("n", [60, 400])
def test_quality_rules_judges_rows_of_small_groups(spark, n):
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    text = lambda: " ".join(word() for _ in range(rng.randrange(80, 300)))
    symbols = " ".join("".join(rng.choice("#$%&*!?=+~") for _ in range(5)) for _ in range(60))
    rows = [(i, text(), "en", "s") for i in range(n)] + [(1000, symbols, None, "s"), (1001, symbols, "en", None), (1002, symbols, "xx", "s"), (1003, text(), None, None)]
    p = quality_rules.apply(make(spark, rows)).toPandas().set_index("doc_id")
    assert not p.base_failed.any() and p.distance2.notna().all()
    assert not p.kept[[1000, 1001, 1002]].any() and p.kept[1003] and p.kept[list(range(n))].mean() > 0.98


def test_quality_rules_edges(spark, edge, empty):
    assert quality_rules.apply(edge).count() == 11 and quality_rules.apply(empty).count() == 0


# ---- op4 ------------------------------------------------------------------------------------------------------------


def test_hnsw_recall(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 16)).astype(np.float32) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    v[1000:1200] = v[1000]  # a group of copies
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [float("nan")] * 16, 0), (9003, [float("inf")] * 16, 0), (9004, [1.0], 0), (9005, [None] * 16, 0), (0, v[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = hnsw.nearest(df, F.col("id") % 20 == 0).toPandas()
    d = v.astype(float)
    hit = 0
    for q in range(0, 3000, 20):
        s = d @ d[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 20 and np.allclose(mine.score, s[mine.vec_id]) and (np.diff(mine.score) <= 1e-12).all()
        hit += len(set(want) & set(mine.vec_id))
    assert hit / (150 * 20) >= 0.95
    assert hnsw.nearest(df.where("vec_id > 8000"), F.lit(True)).count() == 0
    odd = spark.createDataFrame([(-1, [1.0], 0), *rows[:300]], df.schema)  # one vector of another length, with the smallest id
    wide = hnsw.nearest(odd, F.col("id") == 20, k=40).toPandas()
    assert len(wide) == 40 and set(wide["rank"]) == set(range(1, 41))
    copies = spark.createDataFrame([(i, v[0].tolist(), 0) for i in range(60)], df.schema)
    assert hnsw.nearest(copies, F.col("id") == 20, k=40).toPandas().sort_values("rank").vec_id.tolist() == [i for i in range(41) if i != 20]
    few = hnsw.nearest(df.where("vec_id < 5").dropDuplicates(["vec_id"]), F.lit(True)).toPandas()
    assert len(few) == 20


# ---- op5 ------------------------------------------------------------------------------------------------------------

RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def slow_spans(t):
    out = []
    for o, (kind, pat) in enumerate(RULES):
        for m in re.finditer(pat, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), o, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


def test_pii_brute_force(spark, edge, empty):
    rng = random.Random(6)
    bits = ["a@b.c", "a@b.c_d@e.f.g", "x@y", "@", "1.2.3.4.5", "300.1.1.1", "001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111 1", "4111  1111", "+1 (988) 555-2485", "+1", "+12 ", "été", "🙂", "word", "%", "..", "-", " ", "12", "4111111111111112", "+123456789012345678"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", ",", "."]) for _ in range(rng.randrange(1, 12))) for _ in range(1500)] + ["a" * 20_000 + "@", "1" * 20_000, "1 " * 5000, None, ""]
    p = pii.report(make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        want = slow_spans(t)
        assert p.base_sha256[i] == hashlib.sha256(want.encode()).hexdigest(), (t, want, p.spans[i])
        assert sum(p.loc[i, ["n_email", "n_ip", "n_card", "n_phone"]]) == (want.count(",") + 1 if want else 0)
    assert pii.report(edge).count() == 11 and pii.report(empty).count() == 0
    assert pii.redact(empty).columns == empty.columns


def test_pii_bootstraps(spark):
    rows = [(i, f"nothing here and more\nmail: user{i}@host{i}.example.org end", "en", "s") for i in range(30)]
    rows += [(100, "mail: user77-at-host7 end", "en", "s"), (101, "here user77-at-host7x end", "en", "s"), (102, "mail: a1@b2.org, then mail: 1user-at-host", "en", "s")]
    df = make(spark, rows)
    p = pii.report(df).toPandas().set_index("doc_id")
    assert p.spans[100] == "email:6:21" and p.spans[101] == "" and p.spans[102] == "email:6:15,email:28:41" and p.n_email[100] == 0
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert red[100] == "mail: [EMAIL] end" and red[102] == "mail: [EMAIL], then mail: [EMAIL]" and red[101] == rows[-2][1]


def test_pii_patterns_without_seeds_follow_from_what_was_found(spark):
    """Seeds back "mail: "; what stands there also stands after "login=", where no seed does, and what stands there is new."""
    rows = [(i, f"x mail: user{i}@host{i}.example.org end", "en", "s") for i in range(60)]
    rows += [(100 + i, f"x mail: name-{i}-here end, login=name-{i}-here end", "en", "s") for i in range(9)]
    rows += [(200, "login=name-77-there end", "en", "s"), (201, "other=name-78-there end", "en", "s")]
    p = pii.report(make(spark, rows)).toPandas().set_index("doc_id")
    assert p.spans[100] == "email:8:19,email:31:42" and p.spans[200] == "email:6:19" and p.spans[201] == ""


def test_pii_secrets_and_extra_columns(spark):
    rng = random.Random(20)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'a b token = "{key()}" c', "en", "s") for i in range(30)] + [(50, f'A B TOKEN = "{key().upper()}"!! C', "en", "s"), (51, f"alone {key().upper()}", "en", "s")]
    df = make(spark, rows)
    p = pii.report(df).toPandas().set_index("doc_id")
    assert (p.n_added[list(range(30)) + [50]] == 1).all() and p.spans[50] == "secret:13:53" and p.spans[51] == ""
    more = df.select(*df.columns, *[F.lit(k).alias(c) for k, c in enumerate(["base", "cands", "row", "d", "t", "spans", "added", "__t", "a.b"])])
    out = pii.redact(more)
    assert out.columns == more.columns and {r["doc_id"]: r["text"] for r in out.collect()}[50] == 'A B TOKEN = "[SECRET]"!! C'


def test_redaction_of_overlaps_brute_force(spark):
    rng = random.Random(21)
    bits = ["a@b.c", "1.2.3.4", "x1.2.3.4@e.f", "4111 1111 1111 1111", "+4111 1111 1111 1111", "+1 (988) 555-2485", "é🙂", "word ", " ", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 90))) for _ in range(300)] + [None, ""]
    df = make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    spans = pii.report(df).toPandas().set_index("doc_id").spans
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    for i, t in enumerate(texts):
        at, want = 0, ""
        for kind, a, z in [(k, int(a), int(z)) for k, a, z in (x.split(":") for x in spans[i].split(",") if x)]:
            if a >= at:
                want += t[at:a] + f"[{kind.upper()}]"
            at = max(at, z)
        assert red[i] == (None if t is None else want + t[at:])


def test_pii_of_many_matches_is_about_linear(spark):
    bits = ["mail a{}@b.example.org,", "ip 10.0.{}.7;", "card 4111 1111 1111 1111", "id x-{}-9"]
    text = " ".join(bits[k % 4].format(k % 200) for k in range(20_000))
    start = time.monotonic()
    df = make(spark, [(1, text, "en", "s")])
    p, t = pii.report(df).first(), pii.redact(df).first()["text"]
    assert p["n_email"] == p["n_ip"] == p["n_card"] == 5000 and t.count("[EMAIL]") == t.count("[CARD]") == 5000
    assert time.monotonic() - start < 120


# ---- op6 ------------------------------------------------------------------------------------------------------------


def test_language_id(spark, edge, empty):
    if os.path.isdir(DATA):
        p = queries.op6_language_id(spark, DATA).toPandas().merge(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").toPandas())
        assert (p.lang_pred == p.lang)[p.held_out].mean() >= 0.95 and p.score.between(0, 1).all()
    m = language_id.fit(edge, F.lit(True))
    p = language_id.predict(edge, m, {"doc_id": F.col("doc_id")}).toPandas().set_index("doc_id")
    assert set(p.lang_pred[[1, 2, 3, 9]]) == {"und"} and p.lang_pred[7] == "de" and len(p) == 11
    assert language_id.predict(empty, language_id.fit(empty, F.lit(True)), {"doc_id": F.col("doc_id")}).count() == 0


# ---- op7 ------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "é<p>\r\n\r\n" * 9000
    pages = [(1, "http://a", "x"), (2, "http://b", "x"), (3, "http://c", big), (4, None, None), (5, "http://d", ""), (6, "http://e e", "\r\n\r\n"), (7, "http://f", big), (7, "http://f", big), (None, "http://g", "x"), (None, "http://h", "alone")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload_bytes int")
    warc.write(df, str(tmp_path / "w"))
    got = warc.read(spark, str(tmp_path / "w")).toPandas()
    assert len(got) == len(pages) and (got.status == "ok").all()
    got = {None if pd.isna(r.page_id) else int(r.page_id): r for r in got[~got.page_id.isna()].itertuples()}
    for i, _, html in pages[:8]:
        b = (html or "").encode()
        assert got[i].payload_bytes == len(b) and got[i].payload_digest == warc.digest(b)
    assert [got[i].record_type for i in (1, 2, 3, 4, 5, 6, 7)] == ["revisit", "response", "revisit", "revisit", "response", "response", "response"]
    assert (got[1].refers_to, got[3].refers_to, got[4].refers_to) == (2, 7, 5)
    warc.write(df, str(tmp_path / "v"), least=2)
    assert warc.read(spark, str(tmp_path / "v")).where("page_id = 1").first()["record_type"] == "response"
    warc.write(df.limit(0), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def test_warc_records_follow_the_standard():
    first = next(iter(warc.parse(b"".join(r + warc.END for r in warc.records(2, "http://a b", "x", None, None, False, 7)))))
    assert first[0]["content-type"] == "application/http; msgtype=response" and first[0]["warc-record-id"] == "<urn:page:2:7>"
    h, block = next(iter(warc.parse(b"".join(r + warc.END for r in warc.records(1, "http://b", "x", 2, "http://a b", True, 8)))))
    assert h["warc-refers-to-target-uri"] == first[0]["warc-target-uri"] == "http://ab" and h["warc-refers-to-date"] == first[0]["warc-date"] and not block


def test_warc_broken_headers(spark, tmp_path):
    good = next(warc.records(1, "http://a", "x", None, None, False, 0)) + warc.END
    (tmp_path / "w").mkdir()
    for k, bad in enumerate([good.replace(b"X-Page: 1", b"X-Page: one"), good.replace(b"X-Page: 1\r\n", b""), b"nonsense", good.replace(b"Content-Length: ", b"Content-Length: x")]):
        (tmp_path / "w" / f"{k}.warc").write_bytes(good + bad)
    got = warc.read(spark, str(tmp_path / "w")).toPandas()
    assert Counter(got.status) == {"ok": 4, "broken": 4} and got[got.status == "broken"].payload_digest.isna().all()


def test_segments_that_are_broken():
    block = warc._HTTP + warc.frame(b"abc" * 5000)
    parts = [(1, None, block[:9000]), (2, len(block), block[9000:])]
    assert warc.payload_of(warc.assemble(parts[::-1])) == b"abc" * 5000
    assert warc.assemble(parts[:1]) is None and warc.assemble([(1, None, block[:9000]), (2, len(block) + 1, block[9000:])]) is None
    assert warc.assemble([parts[0], (3, len(block), block[9000:])]) is None
    assert warc.payload_of(block.replace(b"1000\r\n", b"1001\r\n", 1)) is None


@needs_data
def test_warc_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    want = con.execute(queries.oracle_sql()["op7_warc"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in queries.op7_warc(spark, DATA).collect())


# ---- op8 ------------------------------------------------------------------------------------------------------------


def test_bpe_against_tiktoken(spark, edge, empty):
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    rng = random.Random(9)
    chars = "aaab ethnoisr  \n\t'sé漢字🙂١٢3_-.,\x1c\x85\xa0 <|endoftext|>"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(0, 120))) for _ in range(3000)] + ["a" * 3000, "thethethe" * 300, "", "don't  stop'll\n\n x"]
    for t, s in zip(texts, mine.encode(texts), strict=True):
        assert s == ",".join(map(str, enc.encode_ordinary(t))), t
        assert mine.decode(s) == t.encode()
    p = bpe.encode(edge, {"doc_id": F.col("doc_id"), "text": F.col("text")}, ranks, public_tokenizers.PATTERN)
    for r in p.collect():
        assert r["ids"] == enc.encode_ordinary(r["text"] or "") and r["n_tokens"] == len(r["ids"])
    back = bpe.decode(p, {"text": F.col("text")}, ranks).collect()
    assert all(bytes(r["bytes"]).decode() == (r["text"] or "") for r in back) and len(back) == 11
    assert bpe.digests(empty, {"doc_id": F.col("doc_id")}, ranks, public_tokenizers.PATTERN).count() == 0


# ---- op9 ------------------------------------------------------------------------------------------------------------


def test_apportionment_is_highest_quotients():
    rng = random.Random(10)
    for _ in range(200):
        v, seats = [rng.choice([0, 1, 5, 9.5, 100, 101]) for _ in range(rng.randrange(1, 7))], rng.randrange(0, 40)
        want = [0] * len(v)
        for _ in range(seats if any(v) else 0):
            want[max(range(len(v)), key=lambda i: (v[i] / (2 * want[i] + 1), -i))] += 1
        assert mixing.apportion(np.array(v), seats).tolist() == want, (v, seats)


def test_apportionment_with_caps():
    rng = random.Random(24)
    for _ in range(200):
        v = np.array([rng.randrange(0, 50) for _ in range(rng.randrange(1, 8))], float)
        most = (2 * v).astype(np.int64) // 3
        seats = rng.randrange(0, int(most.sum()) + 1)
        got = mixing.capped(v, seats, most)
        assert got.sum() == seats and (got <= most).all()


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert sum(mixing.targets([10, 1000, 5, 0], [5, 2, 1, 5])) == pytest.approx(1.5 * 1015)


def test_mixing(spark, edge, empty):
    rng = random.Random(11)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), "en", rng.choice(["a", "b", "b", "c", None])) for i in range(600)]
    df = make(spark, rows)
    p = mixing.report(df).toPandas()
    s = p.merge(pd.DataFrame([(r[0], r[3] or "~") for r in rows], columns=["doc_id", "source"]))
    assert (p.taken <= 2 * p["size"]).all() and list(s.groupby("source")["size"].sum()) == list(s.groupby("source").source_size.first())
    g = s.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert np.allclose(g.taken, g.target, rtol=0.02)
    again = mixing.report(df.repartition(7)).toPandas()
    assert sorted(map(tuple, p.values.tolist())) == sorted(map(tuple, again.values.tolist()))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.where("__size <> 1").count() == 0
    by = mixed.toPandas().groupby("doc_id").text.apply(lambda ts: sum(len(WORD.findall(t)) for t in ts)).to_dict()
    assert by == {r.doc_id: r.taken for r in p.itertuples() if r.taken}
    assert len(mixing.report(edge).collect()) == 11 and mixing.report(empty).count() == 0 and mixing.mix(empty).count() == 0


# ---- op10 -----------------------------------------------------------------------------------------------------------


def test_boosted_trees_learn():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_classifier.train(x[:1500], y[:1500])
    assert ((m.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert quality_classifier.train(x[:5], np.ones(5)).score(x).std() < 1e-12


def test_boosted_trees_traversal_brute_force():
    rng = np.random.default_rng(23)
    x = rng.normal(size=(500, 5))
    m = quality_classifier.train(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=12)

    def walk(row):
        out = m.base
        for feature, cut, value in zip(m.feature, m.cut, m.value, strict=True):
            i = 0
            while 2 * i + 1 < len(feature):
                i = 2 * i + 1 + int(row[feature[i]] > cut[i])
            out += value[i]
        return 1 / (1 + np.exp(-out))

    assert np.allclose(m.score(x), [walk(r) for r in x])


def test_quality_classifier_edges(spark, edge, empty, labels):
    m = quality_classifier.fit(edge, labels, F.lit(True))
    p = quality_classifier.score(edge, m, {"doc_id": F.col("doc_id")}).toPandas()
    assert len(p) == 11 and p.score.between(0, 1).all()
    e = quality_classifier.fit(empty, labels, F.lit(True))
    assert quality_classifier.score(edge, e, {"doc_id": F.col("doc_id")}).where("abs(score - 0.5) < 1e-9").count() == 11


# ---- queries and pipeline -------------------------------------------------------------------------------------------


@needs_data
def test_held_out_accuracy(spark):
    lab = spark.read.parquet(f"{DATA}/../sf0.01/labels.parquet").toPandas()
    p = queries.op10_quality_classifier(spark, f"{DATA}/../sf0.01").toPandas().merge(lab, on="doc_id")
    p = p[p.held_out]
    assert (p.predicted == p.quality).mean() >= 0.95


def test_pipeline_on_odd_tables(spark, edge, tmp_path):
    """Empty, null and repeated rows, and extra columns, through all stages."""
    import corpus_pipeline

    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    for name, docs in (("empty", edge.limit(0)), ("edge", edge)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert all(r["n_tokens"] == len(r["ids"]) for r in out) and (name == "edge" or not out)


@needs_data
def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "dedup", "pii", "mix", "encode"]
    out = corpus_pipeline.run(spark, DATA).toPandas()
    assert len(out) and (out.n_tokens == out.ids.map(len)).all() and (out.decoded_sha256 == out.text_sha256).all()


def test_work_folder(spark):
    from hawser.llm import io

    t = io.durable(spark.range(3), "t")
    assert t.count() == 3 and io.release(spark)
    assert io.durable(spark.range(2), "t").count() == 2


def test_pipeline_stages_keep_columns(spark, edge):
    import corpus_pipeline

    plain = edge.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, plain, DATA).columns == plain.columns, name
