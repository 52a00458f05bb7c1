"""Changes as new versions of a table: old rows and changes in, current rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """The latest version of every key; of equal versions the new row."""
    both = old.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)))
    latest = Window.partitionBy(*key).orderBy(F.col(version).desc(), F.col("__n").desc())
    return both.withColumn("__r", F.row_number().over(latest)).where("__r = 1").drop("__r", "__n")


def restore(current: DataFrame, dump: DataFrame, key: list[str], mode: int) -> tuple[DataFrame, DataFrame]:
    """The table after a restore, and the keys whose sessions end. Modes: 0 update and add, 1 only add, 2 update, add and
    disconnect those updated."""
    if mode not in (0, 1, 2):
        raise ValueError("mode must be 0, 1 or 2")
    added = dump.join(current.select(*key), key, "left_anti")
    updated = dump.join(current.select(*key), key, "left_semi")
    ended = updated.select(*key) if mode == 2 else updated.select(*key).limit(0)
    if mode == 1:
        return current.unionByName(added.select(*current.columns)), ended
    return current.join(dump.select(*key), key, "left_anti").unionByName(dump.select(*current.columns)), ended


def insert_resolved(rows: DataFrame, dimension: DataFrame, on: str, key: str, out: str, default: int | None = None) -> DataFrame:
    """Rows with a foreign key looked up by name."""
    from .joins import resolve_key

    return resolve_key(rows, dimension, on, key, out, F.lit(default) if default is not None else None)


def first_write(old: DataFrame, seen: DataFrame, key: str, field: str) -> DataFrame:
    """A time that is set once: the stored one if not 0, else the earliest seen."""
    first = seen.groupBy(key).agg(F.min(field).alias("__first"))
    j = old.join(first, key, "left")
    return j.withColumn(field, F.when(F.col(field) == 0, F.coalesce("__first", F.lit(0))).otherwise(F.col(field))).drop("__first")


def compare_and_set(table: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """Versioned update: applied only where the stored version is the one expected. change: key, expected, updated_at."""
    j = table.join(change.select(key, "expected", F.col("updated_at").alias("__at")), key, "left")
    hit = F.col("version") == F.col("expected")
    return j.withColumn("updated_at", F.when(hit, F.col("__at")).otherwise(F.col("updated_at"))).withColumn("version", F.when(hit, F.col("version") + 1).otherwise(F.col("version"))).drop("expected", "__at")


def soft_delete(rows: DataFrame, which: Column, now_ms: int) -> DataFrame:
    return rows.withColumn("deleted_at", F.when(which & (F.col("deleted_at") == 0), F.lit(now_ms)).otherwise(F.col("deleted_at")))


def purge(rows: DataFrame, now_ms: int, after_ms: int = 30 * 60_000) -> DataFrame:
    """Rows left once those deleted long enough ago are gone."""
    return rows.where((F.col("deleted_at") == 0) | (F.col("deleted_at") >= now_ms - after_ms))


def age_out(rows: DataFrame, column: str, before: int) -> DataFrame:
    return rows.where(F.col(column) >= before)


def replace_links(links: DataFrame, parents: DataFrame, parent: str, items: str, item: str) -> DataFrame:
    """A parent's links rewritten from its list, numbered in order. parents: parent, items (array)."""
    new = parents.select(parent, F.posexplode(items).alias("sort_order", item))
    return links.join(parents.select(parent), parent, "left_anti").select(parent, item, "sort_order").unionByName(new.select(parent, item, "sort_order"))


def touch(rows: DataFrame, links: DataFrame, changed: DataFrame, key: str, now_ms: int) -> DataFrame:
    """updated_at of the rows linked to something that changed. links: key, other; changed: other."""
    hit = links.join(changed, [c for c in changed.columns if c in links.columns], "left_semi").select(key).distinct().withColumn("__hit", F.lit(True))
    return rows.join(hit, key, "left").withColumn("updated_at", F.when(F.col("__hit"), F.lit(now_ms)).otherwise(F.col("updated_at"))).drop("__hit")


_RESERVED = "share string, seq long, n long, granted boolean"


def reserve_tokens(requests: DataFrame) -> DataFrame:
    """Which requests get their tokens, in order, when a refused one frees nothing it did not take: a fold by share. requests:
    share, seq, n, used, max_tokens (0: no limit)."""
    import pandas as pd

    from ..ship import ship

    ship(requests.sparkSession)

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("seq")
        used, out = int(f.used.iloc[0]), []
        for n, cap in zip(f.n.tolist(), f.max_tokens.tolist(), strict=True):
            ok = cap == 0 or used + n <= cap
            used += n if ok else 0
            out.append(ok)
        return f.assign(granted=out)[["share", "seq", "n", "granted"]]

    return requests.groupBy("share").applyInPandas(fold, _RESERVED)
