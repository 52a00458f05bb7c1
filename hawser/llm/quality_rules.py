"""Quality rules: base thresholds, then robust multivariate outliers per language and source.

The statistic vector of a document is transformed (logs), and every (lang, source) group gets a minimum-covariance-
determinant estimate: from each of five starts (medians with MADs, tanh and spatial-sign shapes or interquartile ranges;
mean and covariance), concentration steps re-estimate mean and covariance from the ``HALF`` share of rows with the
smallest Mahalanobis distance until the log determinant falls by no more than ``TOLERANCE``; the start that ends at the
smallest determinant is taken. All rows take part in every step; the steps are grouped aggregates with map-side partial
sums, so a group that holds a third of all rows is no hot key.
The covariance is regularised by FLOOR (a statistic that is constant in a group must not make any deviation infinite).
Rows of groups of under MIN_ROWS rows are held against the estimate of their whole language, or of the whole table if the
language is that small too; every row has a verdict, whatever the size of the table.

Cases: null or empty text has no words and fails the base rule; null lang or source is a group of its own; repeated
rows each get a row; other columns of the table are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .io import durable, map_blocks
from .text_stats import base_stats

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
DIMS = ["z_words", "z_len", "z_symbols", "z_lines", "z_repeat"]
#: Least standard deviation of each transformed statistic. For shares of repetition it is that of about 0.4 in 100, so
#: that a document far below the base thresholds can still be an outlier.
FLOOR = [0.5, 0.08, 0.5, 0.35, 0.35]
HALF, TOLERANCE, MIN_ROWS, BROADCAST_GROUPS = 0.5, 1e-3, 200, 10_000
#: Chi-square with 5 degrees of freedom: its median, and its 0.99999 quantile, beyond which a row is an outlier.
CHI2_MEDIAN, CUTOFF = 4.351, 30.86


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text."""
    fields = [T.StructField(k, T.LongType()) for k in [*COUNTS, "n_lines"]]

    def fn(b):
        s = base_stats(b)
        return [s[f.name] for f in fields]

    keep = {"doc_id": F.col("doc_id"), "lang": F.col("lang"), "source": F.col("source")}
    return map_blocks(docs, keep, F.col("text"), fn, fields)


def transformed(stats: DataFrame) -> DataFrame:
    share = lambda a, b: F.log1p(100.0 * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return (
        stats.withColumn("z_words", F.log1p("n_words"))
        .withColumn("z_len", F.log1p(F.col("word_chars") / F.greatest("n_words", F.lit(1))))
        .withColumn("z_symbols", share("n_symbols", "word_chars"))
        .withColumn("z_lines", share("n_dup_lines", "n_lines"))
        .withColumn("z_repeat", share("n_repeat_words", "n_words"))
    )


def _grouped(z: DataFrame) -> DataFrame:
    """Adds ``g``, the group whose estimate a row is held against, and ``fits``, the groups whose estimates it enters.

    A (lang, source) cell of under MIN_ROWS rows is held against its whole language, or against all rows if that is small
    too; those estimates are of all rows of the language or table, not of the small cells alone.
    """
    tag = lambda *c: F.to_json(F.struct(*c))
    cell = z.groupBy("lang", "source").count().withColumnRenamed("count", "n_cell")
    cell = durable(cell.withColumn("big", F.col("n_cell") >= MIN_ROWS), "cells")
    of_lang = cell.groupBy(F.col("lang").alias("l_lang")).agg((F.sum("n_cell") >= MIN_ROWS).alias("l_big"), (~F.every("big")).alias("l_used"))
    cell = cell.join(of_lang, F.col("lang").eqNullSafe(F.col("l_lang")))
    any_small = F.lit(cell.where("NOT big AND NOT l_big").limit(1).count() > 0)
    own, whole = tag(F.lit("cell").alias("k"), "lang", "source"), tag(F.lit("lang").alias("k"), "lang")
    fits = F.array(F.when(F.col("big"), own), F.when(F.col("l_big") & F.col("l_used"), whole), F.when(any_small, F.lit("all")))
    cell = cell.select(
        F.col("lang").alias("c_lang"), F.col("source").alias("c_source"),
        F.when(F.col("big"), own).when(F.col("l_big"), whole).otherwise(F.lit("all")).alias("g"), F.array_compact(fits).alias("fits"),
    )
    cell = durable(cell, "cells")
    return _by_group(z, cell, F.col("lang").eqNullSafe(F.col("c_lang")) & F.col("source").eqNullSafe(F.col("c_source")), cell.count(), "left").drop("c_lang", "c_source")


def _by_group(rows: DataFrame, table: DataFrame, condition, groups: int, how: str = "inner") -> DataFrame:
    """A join with a table of one row a group: broadcast if there are at most BROADCAST_GROUPS (under 1 kB a row), else shuffled."""
    return rows.join(F.broadcast(table) if groups <= BROADCAST_GROUPS else table, condition, how)


_PARAMS = "g string, s int, n long, m array<double>, p array<double>, ld double"
PAIRS = [(i, j) for i in range(len(DIMS)) for j in range(i, len(DIMS))]


def _square(upper: np.ndarray) -> np.ndarray:
    full = np.zeros((len(DIMS), len(DIMS)))
    for (i, j), x in zip(PAIRS, upper, strict=True):
        full[i, j] = full[j, i] = x
    return full


def _row(g, s, n, mean, cov, det: bool):
    """One estimate: the inverse of the regularised covariance and, of a concentrated subset, its log determinant."""
    cov = cov + np.diag(np.square(FLOOR))
    return g, int(s), int(n), mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1]) if det else np.inf


def _moments(mean_sums, cross_sums, count):
    mean = np.array(mean_sums, float) / count
    return mean, _square(np.array(cross_sums, float) / count) - np.outer(mean, mean)


def _starts(frames):
    """Five starts of every group: median with MADs, tanh and spatial-sign shapes, IQRs; mean with covariance."""
    d = len(DIMS)
    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            mid, mad, iqr = (np.array(x, float) for x in (r.mid, r.mad, r.iqr))
            signs = _square(np.array(r.signs, float))
            signs *= d / max(np.trace(signs), 1e-9)
            covs = [np.diag(mad**2), np.outer(mad, mad) * _square(np.array(r.tanhs, float) / r.n), np.outer(mad, mad) * signs, np.diag(iqr**2)]
            out += [_row(r.g, s, r.n, mid, c, False) for s, c in enumerate(covs)]
            out.append(_row(r.g, len(covs), r.n, *_moments(r.sums, r.crosses, r.n), False))
        yield pd.DataFrame(out, columns=["g", "s", "n", "m", "p", "ld"])


def _estimate(frames):
    """Sums over concentrated subsets to mean, inverse covariance and determinant, a row of sums at a time."""
    d = len(DIMS)
    for f in frames:
        # Concentration shrinks the spread; the factor is set by the last median instead.
        out = [_row(r.g, r.s, r.n, *_moments(r.sums[:d], r.sums[d:], r.h), True) for r in f.itertuples(index=False)]
        yield pd.DataFrame(out, columns=["g", "s", "n", "m", "p", "ld"])


def _distance():
    d = len(DIMS)
    e = [F.col(k) - F.col("m")[i] for i, k in enumerate(DIMS)]
    terms = [e[i] * e[j] * F.col("p")[i * d + j] for i in range(d) for j in range(d)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _first(z: DataFrame) -> DataFrame:
    """The starting estimates: g, s (number of the start), n, m, p, ld (infinite: not concentrated yet)."""
    d = range(len(DIMS))
    q = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    mid = z.groupBy("g").agg(F.count("*").alias("n"), *[F.percentile_approx(k, q, 1000).alias(f"q{i}") for i, k in enumerate(DIMS)])
    mid = durable(mid.select("g", "n", F.array(*[F.col(f"q{i}")[1] for i in d]).alias("mid"), F.array(*[(F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349 for i in d]).alias("iqr")), "mcd")
    groups = mid.count()
    mads = _by_group(z, mid, "g", groups).groupBy("g").agg(F.array(*[1.4826 * F.percentile_approx(F.abs(F.col(k) - F.col("mid")[i]), 0.5, 1000) for i, k in enumerate(DIMS)]).alias("mad"))
    mid = durable(mid.join(mads, "g"), "mcd")
    u = [(F.col(k) - F.col("mid")[i]) / F.greatest(F.col("mad")[i], F.lit(FLOOR[i])) for i, k in enumerate(DIMS)]
    at = _by_group(z, mid, "g", groups).select("g", *DIMS, *[x.alias(f"u{i}") for i, x in enumerate(u)])
    at = at.withColumn("norm", F.greatest(sum((F.col(f"u{i}") * F.col(f"u{i}") for i in d), F.lit(0.0)), F.lit(1e-9)))
    sums = at.groupBy("g").agg(
        F.array(*[F.sum(F.tanh(f"u{i}") * F.tanh(f"u{j}")) for i, j in PAIRS]).alias("tanhs"),
        F.array(*[F.sum(F.col(f"u{i}") * F.col(f"u{j}") / F.col("norm")) for i, j in PAIRS]).alias("signs"),
        F.array(*[F.sum(k) for k in DIMS]).alias("sums"),
        F.array(*[F.sum(F.col(DIMS[i]) * F.col(DIMS[j])) for i, j in PAIRS]).alias("crosses"),
    )
    return mid.join(sums, "g").mapInPandas(_starts, _PARAMS)


def estimates(z: DataFrame) -> DataFrame:
    """MCD parameters of every group: g, n, m (centre), p (inverse covariance, row by row), med (median distance)."""
    d = len(DIMS)
    live, ended = durable(_first(z), "mcd"), []
    # h of n rows is (n + d + 1) / 2, in steps of a twentieth: HALF of large groups, more of very small ones.
    shares = [HALF + k / 20 for k in range(int((1 - HALF) * 20) + 1)]
    step = F.ceil((F.col("n") + d + 1) / (2 * F.col("n")) * 20 - HALF * 20 - 0.1).cast("int")
    sums = [F.sum(k) for k in DIMS] + [F.sum(F.col(DIMS[i]) * F.col(DIMS[j])) for i, j in PAIRS]
    while rows := live.count():
        at = _by_group(z, live, "g", rows).withColumn("d2", _distance())
        cut = at.groupBy("g", "s").agg(F.max("n").alias("n"), F.percentile_approx("d2", F.array(*map(F.lit, shares)), 1000).alias("cuts"))
        cut = cut.select(F.col("g").alias("cut_g"), F.col("s").alias("cut_s"), F.col("cuts")[F.least(F.greatest(step, F.lit(0)), F.lit(len(shares) - 1))].alias("cut"))
        near = _by_group(at, cut, (F.col("g") == F.col("cut_g")) & (F.col("s") == F.col("cut_s")), rows).where(F.col("d2") <= F.col("cut"))
        moments = near.groupBy("g", "s").agg(F.max("n").alias("n"), F.count("*").alias("h"), F.array(*sums).alias("sums"))
        was = live.select("g", "s", F.col("ld").alias("was"))
        after = durable(moments.mapInPandas(_estimate, _PARAMS).join(was, ["g", "s"]), "mcd")
        # Every further step lowers a determinant that the floor bounds from below, so this ends.
        more = F.col("was") - F.col("ld") > TOLERANCE
        ended.append(after.where(~more).drop("was"))
        live = after.where(more).drop("was")
    best = ended[0] if ended else live
    for e in ended[1:]:
        best = best.unionByName(e)
    params = durable(best.groupBy("g").agg(F.min_by(F.struct("n", "m", "p"), F.struct("ld", "s")).alias("e")).select("g", "e.*"), "mcd")
    groups = params.count()
    med = _by_group(z, params, "g", groups).withColumn("d2", _distance()).groupBy("g").agg(F.percentile_approx("d2", 0.5, 1000).alias("med")).withColumnRenamed("g", "med_g")
    return params.join(med, F.col("g") == F.col("med_g")).drop("med_g")


def apply(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the squared robust distance."""
    stats = durable(statistics(docs), "stats")
    z = _grouped(transformed(stats))
    params = durable(estimates(z.select(F.explode("fits").alias("g"), *DIMS)), "mcd")
    # Distances are scaled down where the bulk is wider than the estimate says, never up.
    scaled = F.col("d2") * F.least(F.lit(1.0), F.lit(CHI2_MEDIAN) / F.greatest(F.col("med"), F.lit(1e-9)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        _by_group(z, params.withColumnRenamed("n", "group_rows"), "g", params.count(), "left")
        .withColumn("d2", _distance())
        .withColumn("distance2", scaled)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("distance2") <= CUTOFF))
        .select("doc_id", *COUNTS, "base_failed", "kept", "distance2")
    )
