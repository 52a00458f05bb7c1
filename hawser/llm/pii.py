"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Base finders give the seeds: e-mail addresses, IPv4 addresses, card numbers (Luhn), telephone numbers, leftmost and not
overlapping per kind. A further finder gives seeds of a kind that is no base one: secrets, lower-case hex keys of 32 to 64
digits. Strings that look like an identifier and overlap no seed are candidates. Every seed and candidate is an instance and
stands in lexical patterns: the word to its left with the punctuation between; the two words to its left; the word to its
left together with the one to its right. Patterns and distinct instances make a graph, which is scored in turns:

* a pattern's confidence for a kind is the sum of its instances' scores over one more than the number of its instances;
* an instance's score for a kind is 1 - prod(1 - confidence) over its patterns; seeds have 1, others begin at 0;
* patterns of at least CONFIDENCE that LEAST instances known so far back become high-confidence; the candidates that these
  raise above CONFIDENCE are known in the next turn, and so can back patterns in which no seed stands.

A candidate in a high-confidence pattern becomes a span of the pattern's kind (of the surest, if there are several). Patterns
are a table and are joined, so there may be any number.

Every step is about linear in a text, or grows with the square root of its matches more: regular expressions match runs
possessively and only from their first character (or the end of the match before); places come from running sums in two
levels; overlaps are found by equal cells of CELL characters.

Cases: null text is empty; positions are code points, end exclusive; repeated rows each get a row; texts of any length;
an empty table gives no rows and no patterns; columns of any name, as they travel inside one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .io import durable

KINDS = ["email", "ip", "card", "phone"]
SEEDS = [*KINDS, "secret"]
LEAST, CONFIDENCE, TURNS = 5, 0.8, 4
CELL, LEFT, RIGHT, SMALL_TABLE = 64, 48, 32, 100_000

_LOCAL = "A-Za-z0-9._%+-"
PATTERN = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A maximal chain of digits with single separators, of 12 to 19 digits.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z])(?=[a-f]{0,63}[0-9])(?=[0-9]{0,63}[a-f])[0-9a-f]{32,64}+(?![0-9A-Za-z])",
}
#: What a text must hold for a finder to be worth a scan.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Identifier-like: a run of at least six of these characters, one of them a digit.
_ID = "A-Za-z0-9._%+@/-"
CANDIDATE = rf"(?<![{_ID}])(?=[A-Za-z._%+@/-]{{0,64}}[0-9])[{_ID}]{{6,}}+"
_WORD, _BETWEEN = r"[\p{L}_]{1,30}", r"[^\p{L}\p{N}_]"
_LEFT_1, _LEFT_2 = rf"({_WORD}{_BETWEEN}{{0,6}})$", rf"({_WORD}{_BETWEEN}{{1,6}}{_WORD}{_BETWEEN}{{0,6}})$"
_RIGHT_1 = rf"^({_BETWEEN}{{0,3}}{_WORD})"


def _luhn(digits: Column) -> Column:
    each = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    doubled = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _running(values: Column, step) -> Column:
    """What ``step`` has made, from 0 on, of the elements before each one. In runs of about the square root of their number:
    an array that grows by one element at a time would be copied as often."""
    run = F.greatest(F.ceil(F.sqrt(F.size(values))), F.lit(1)).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / run).cast("int")), lambda i: F.slice(values, i * run + 1, run))
    zero = F.lit(0).cast("bigint")

    def inside(at, xs):
        start = F.struct(at.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(xs, start, lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def over(acc, xs):
        one = inside(acc["at"], xs)
        return F.struct(one["at"].alias("at"), F.concat(acc["out"], F.array(one["out"])).alias("out"))

    first = F.struct(zero.alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
    return F.flatten(F.aggregate(runs, first, over, lambda acc: acc["out"]))


_SPAN = "array<struct<start:bigint,end:bigint,ord:int,kind:string,value:string,near:array<string>>>"


def _near(left: Column, right: Column) -> Column:
    """The patterns of an instance between these texts."""
    fold = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    left, right = fold(F.right(left, F.lit(LEFT))), fold(F.left(right, F.lit(RIGHT)))
    one, two, after = F.regexp_extract(left, _LEFT_1, 1), F.regexp_extract(left, _LEFT_2, 1), F.regexp_extract(right, _RIGHT_1, 1)
    both = F.when((one != "") & (after != ""), F.concat(F.lit("b "), one, F.lit("\t"), after))
    return F.array_compact(F.array(F.when(one != "", F.concat(F.lit("l "), one)), F.when(two != "", F.concat(F.lit("m "), two)), both))


def _located(text: Column, pattern: str, kind: str, order: int, when: Column) -> Column:
    """Every match with its place, from the lengths of the gaps and matches before it, and its patterns."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(_SPAN)

    def spans(found, gaps):
        step = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("bigint"))

        def one(m, i, before):
            start = F.get(before, i) + F.length(F.get(gaps, i))
            near = _near(F.get(gaps, i), F.get(gaps, i + 1))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), m.alias("value"), near.alias("near"))

        return F.get(F.transform(F.array(_running(step, lambda a, x: a + x)), lambda before: F.transform(found, lambda m, i: one(m, i, before))), F.lit(0))

    held = F.get(F.transform(F.array(F.struct(found.alias("f"), F.split(text, pattern, -1).alias("g"))), lambda x: F.when(F.size(x["f"]) > 0, spans(x["f"], x["g"])).otherwise(none)), F.lit(0))
    return F.when(when, held).otherwise(none)


def scan(docs: DataFrame, keep: dict[str, Column], text: str = "text", with_text: bool = False) -> DataFrame:
    """A table: row (a number), d (the ``keep`` columns, a struct), t (the text, if asked for), base (spans of the base finders,
    by start), secrets, cands (identifier-like strings, those that overlap other spans too)."""
    d = F.struct(*[c.alias(k) for k, c in keep.items()]) if keep else F.lit(None).cast("string")
    df = docs.select(d.alias("d"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")).withColumn("row", F.monotonically_increasing_id())
    digit = F.col("digit")
    df = df.withColumn("digit", F.col("t").rlike("[0-9]"))
    for i, kind in enumerate([*SEEDS, ""]):
        when = F.contains(F.col("t"), F.lit(_NEEDS[kind])) if kind in _NEEDS else F.lit(True)
        when = when if kind == "email" else digit & when
        df = df.withColumn(kind or "cands", _located(F.col("t"), PATTERN[kind] if kind else CANDIDATE, kind, i, when))
    checked = lambda k: F.filter(k, lambda s: _valid(k, s["value"]))
    base = F.array_sort(F.concat(*[checked(k) for k in KINDS]))
    return df.select("row", "d", *(["t"] if with_text else []), base.alias("base"), F.col("secret").alias("secrets"), "cands")


def _joinable(df: DataFrame) -> DataFrame:
    """Broadcast if the rows are few, as counted; else as it is."""
    return F.broadcast(df) if df.count() <= SMALL_TABLE else df


def _free(scanned: DataFrame) -> DataFrame:
    """row, start, end, value and near of the candidates that overlap no seed."""
    some = scanned.where(F.size("cands") > 0)
    cells = F.explode(F.sequence(F.floor(F.col("s.start") / CELL), F.floor((F.col("s.end") - 1) / CELL))).alias("cell")
    spans = lambda c: some.select("row", F.explode(c).alias("s"))
    taken = spans(F.concat("base", "secrets")).select("row", F.col("s.start").alias("a"), F.col("s.end").alias("z"), cells)
    cand = spans("cands").select("row", "s.start", "s.end", "s.value", "s.near")
    met = spans("cands").select("row", "s.start", "s.end", cells).join(taken, ["row", "cell"]).where("a < end AND start < z").select("row", "start", "end").distinct()
    return cand.join(met, ["row", "start", "end"], "left_anti")


def patterns(scanned: DataFrame, cands: DataFrame) -> DataFrame:
    """near, kind, conf: the high-confidence patterns. scanned: a written table; cands: its free candidates."""
    seeds = scanned.select(F.explode(F.concat("base", "secrets")).alias("s")).select(F.explode("s.near").alias("near"), F.lower("s.value").alias("value"), F.col("s.kind").alias("kind"))
    others = cands.select(F.explode("near").alias("near"), F.lower("value").alias("value"), F.lit(None).cast("string").alias("kind"))
    graph = seeds.unionByName(others).distinct()
    size = graph.groupBy("near").agg(F.count_distinct("value").alias("size")).where(F.col("size") >= LEAST)
    graph = durable(graph.join(size, "near"), "pii-graph")
    first = graph.where("kind is not null").select("value", F.col("kind").alias("as"), F.lit(1.0).alias("score")).distinct()
    known, had, good = first, -1, None
    for _ in range(TURNS):
        backed = graph.join(known, "value").where(F.coalesce("kind", "as") == F.col("as")).groupBy("near", "as").agg(F.sum("score").alias("sum"), F.count_distinct("value").alias("n"), F.max("size").alias("size"))
        sure = backed.where(F.col("n") >= LEAST).select("near", F.col("as").alias("kind"), (F.col("sum") / (F.col("size") + 1)).alias("conf")).where(F.col("conf") >= CONFIDENCE)
        good = durable(sure, "pii-patterns")
        new = graph.where("kind is null").select("near", "value").distinct().join(good, "near").groupBy("value", F.col("kind").alias("as")).agg((1 - F.exp(F.sum(F.log1p(-F.col("conf"))))).alias("score")).where(F.col("score") >= CONFIDENCE)
        new = durable(new, "pii-known")
        have = new.count()
        if have == had:
            break
        known, had = first.unionByName(new), have
    return good


def found(scanned: DataFrame) -> DataFrame:
    """row and added: the spans that the method adds to the base ones of a written table, in rows that have some."""
    order = F.create_map(*[x for i, k in enumerate(SEEDS) for x in (F.lit(k), F.lit(i))])
    cands = durable(_free(scanned), "pii-cands")
    good = _joinable(patterns(scanned, cands))
    hit = cands.select("row", "start", "end", F.explode("near").alias("near")).join(good, "near").groupBy("row", "start", "end").agg(F.max(F.struct(F.col("conf"), F.col("kind"))).alias("best"))
    span = lambda s, e, o, k: F.struct(s.alias("start"), e.alias("end"), o.alias("ord"), k.alias("kind"))
    hit = hit.select("row", span(F.col("start"), F.col("end"), order[F.col("best.kind")], F.col("best.kind")).alias("s"))
    secrets = scanned.where(F.size("secrets") > 0).select("row", F.explode("secrets").alias("s")).select("row", span(F.col("s.start"), F.col("s.end"), F.col("s.ord"), F.col("s.kind")).alias("s"))
    return durable(hit.unionByName(secrets).groupBy("row").agg(F.collect_list("s").alias("added")), "pii-added")


def _spans(scanned: DataFrame) -> DataFrame:
    """The table with ``spans``: all spans by start, then kind as listed."""
    plain = F.transform("base", lambda s: F.struct(s["start"], s["end"], s["ord"], s["kind"]))
    out = scanned.join(_joinable(found(scanned)), "row", "left")
    empty = F.array().cast("array<struct<start:bigint,end:bigint,ord:int,kind:string>>")
    each = F.concat(plain, F.coalesce("added", empty))
    by = F.array_sort(F.transform(each, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return out.withColumn("spans", by)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, the digest of the base spans, all spans, and the number that the method added."""
    df = _spans(durable(scan(docs, {"doc_id": F.col("doc_id")}), "pii-scan"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.array_sort(F.transform("base", lambda s: F.struct(s["start"], s["ord"], s["end"], s["kind"])))
    return df.select("d.doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; a span that begins inside the ones before it only lengthens
    them. Places are counted from the start of a run of spans, of which there are about the square root of their number."""
    n = F.size(spans)
    run = F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("int")

    def whole(x):
        ends, starts = x["ends"], x["starts"]
        at = lambda i: F.get(ends, i)  # noqa: E731  where the spans before end
        cut = lambda t, a, z: F.substring(t, (a + 1).cast("int"), F.greatest(z - a, F.lit(0)).cast("int"))

        def some(k):
            first, last = k * run, F.least((k + 1) * run, n) - 1
            origin = at(first)
            part = F.struct(cut(text, origin, F.greatest(F.get(starts, last), origin)).alias("t"))
            return F.array_join(F.get(F.transform(F.array(part), lambda p: F.transform(F.sequence(first, last), lambda i: F.concat(cut(p["t"], at(i) - origin, F.get(starts, i) - origin), F.when(F.get(starts, i) >= at(i), F.concat(F.lit("["), F.upper(F.get(spans, i)["kind"]), F.lit("]"))).otherwise("")))), F.lit(0)), "")

        body = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / run).cast("int")), some), "")
        end = F.greatest(F.get(ends, n - 1), F.get(spans, n - 1)["end"])
        return F.concat(body, cut(text, end, F.length(text)))

    ends = _running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
    return F.get(F.transform(F.array(F.struct(ends.alias("ends"), F.transform(spans, lambda s: s["start"]).alias("starts"))), whole), F.lit(0))


def redact(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; every span of the text replaced by its kind in brackets. Null texts stay null."""
    names = docs.columns
    df = _spans(durable(scan(docs, {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(names)}, with_text=True), "pii-scan"))
    had = F.col(f"d.c{names.index('text')}")
    df = df.withColumn("new", F.when(had.isNull() | (F.size("spans") == 0), had).otherwise(_replaced(F.col("t"), F.col("spans"))))
    own = {"text": F.col("new"), "n_chars": F.length("new")}
    return df.select(*[own[c].cast(docs.schema[c].dataType).alias(c) if c in own else F.col(f"d.c{i}").alias(c) for i, c in enumerate(names)])
