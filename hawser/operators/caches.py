"""Caches as tables: what stays after a clean-up. Times in milliseconds, now is an argument."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How long an unused password stays, and how many times the limit calls for the second clean-up.
UNUSED_MS, SECOND = 3_600_000, 5


def credentials_kept(cache: DataFrame, now_ms: int, limit: int) -> DataFrame:
    """Cached passwords (username, used_at) after a clean-up: all up to the limit, else those used within the hour; if these are
    still five times the limit or more, only the ``limit`` used last (ties by name)."""
    if cache.count() <= limit:
        return cache
    used = cache.where(F.col("used_at") >= now_ms - UNUSED_MS)
    return used if used.count() < limit * SECOND else used.orderBy(F.col("used_at").desc(), "username").limit(limit)


def users_cached(cache: DataFrame, new: DataFrame, max_size: int) -> DataFrame:
    """Cached users (username, expiration; 0 never expires) with new ones, which replace those of their name; while there are
    too many, old ones go, the soonest to expire first. Users without a name are not cached; max_size 0 is no limit."""
    new = new.where("username <> ''")
    old = cache.join(new.select("username"), "username", "left_anti").select(*cache.columns)
    if max_size > 0 and old.count() > (room := max(max_size - new.count(), 0)):
        old = old.orderBy(F.when(F.col("expiration") == 0, 1).otherwise(0).desc(), F.col("expiration").desc(), "username").limit(room)
    return old.unionByName(new)


def unexpired(cache: DataFrame, now_ms: int) -> DataFrame:
    return cache.where((F.col("expiration") == 0) | (F.col("expiration") >= now_ms))
