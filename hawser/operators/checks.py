"""Scheduled checks. Time is an argument everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .joins import nearest_policy

DAY_MS, HOUR_MS = 86_400_000, 3_600_000


def expired(users: DataFrame, now_ms: int) -> DataFrame:
    return users.where((F.col("expiration_date") > 0) & (F.col("expiration_date") < now_ms))


def inactivity_days(now_ms: int) -> Column:
    """Whole days since the last login, else since creation; truncated toward zero, 0 if neither is known."""
    since = F.when(F.col("last_login") > 0, F.col("last_login")).when(F.col("created_at") > 0, F.col("created_at"))
    return F.coalesce(((F.lit(now_ms) - since) / DAY_MS).cast("int"), F.lit(0))


def inactive(users: DataFrame, now_ms: int, disable_after: int = 0, delete_after: int = 0) -> DataFrame:
    """What to do with idle accounts: ``delete`` past its threshold (disabled ones, or all where nothing is disabled first),
    else ``disable`` enabled ones past theirs."""
    days = F.col("days")
    delete = F.lit(delete_after > 0) & (days > delete_after) & ((F.col("status") == 0) | F.lit(disable_after <= 0))
    disable = F.lit(disable_after > 0) & (days > disable_after) & (F.col("status") > 0)
    out = users.withColumn("days", inactivity_days(now_ms)).withColumn("action", F.when(delete, "delete").when(disable, "disable"))
    return out.where("action is not null")


def password_days(now_ms: int, policy_days: Column) -> Column:
    """Days until the password expires, rounded half away from zero; less than half a day still counts as one."""
    due = F.col("last_password_change") + policy_days.cast("long") * DAY_MS - now_ms
    days = F.round(due / DAY_MS, 0).cast("int")
    return F.when((days == 0) & (due > 0), 1).otherwise(days)


def password_notices(users: DataFrame, now_ms: int, threshold: int, policy: str = "password_expiration") -> DataFrame:
    """Accounts whose password runs out within the threshold; expired accounts and those without a policy are left out."""
    live = (F.col("expiration_date") == 0) | (F.col("expiration_date") >= now_ms)
    return users.where(live & (F.col(policy) > 0)).withColumn("days", password_days(now_ms, F.col(policy))).where(F.col("days") <= threshold)


def retention(files: DataFrame, policies: DataFrame, now_ms: int) -> DataFrame:
    """Files to delete: those older than the hours of their nearest policy folder; 0 hours keeps. files: path, size, mtime_ms;
    policies: policy_path, hours. A file counts once, under its nearest folder."""
    near = nearest_policy(files, policies)
    return near.where((F.col("hours") > 0) & (F.col("mtime_ms") + F.col("hours").cast("long") * HOUR_MS < now_ms))


def retention_report(deleted: DataFrame, policies: DataFrame) -> DataFrame:
    """A row for each folder with hours, zero deletions too."""
    by = deleted.groupBy("policy_path").agg(F.count("*").alias("deleted_files"), F.sum("size").cast("long").alias("deleted_size"))
    return policies.where("hours > 0").join(by, "policy_path", "left").select("policy_path", "hours", F.coalesce("deleted_files", F.lit(0)).cast("long").alias("deleted_files"), F.coalesce("deleted_size", F.lit(0)).cast("long").alias("deleted_size"))


def emptied(files: DataFrame, deleted: DataFrame) -> DataFrame:
    """Directories that hold no file once the deletions are done."""
    below = lambda f: f.select(F.explode(paths.ancestors(paths.parent(F.col("path")))).alias("dir")).distinct()
    return below(deleted).join(below(files.join(deleted.select("path"), "path", "left_anti")), "dir", "left_anti").where("dir <> '/'")


def usage_reset(files: DataFrame, users: DataFrame) -> DataFrame:
    """Recounted files and bytes for every user, none included."""
    by = files.groupBy("username").agg(F.count("*").alias("f"), F.sum("size").alias("s"))
    return users.select("username").join(by, "username", "left").select("username", F.coalesce("f", F.lit(0)).cast("long").alias("used_files"), F.coalesce("s", F.lit(0)).cast("long").alias("used_size"))


def folder_reset(files: DataFrame, folders: DataFrame, names: Column | None = None) -> DataFrame:
    """Recounted files and bytes of every folder (of those that ``names`` admits). files: folder, size; folders: name."""
    by = files.groupBy(F.col("folder").alias("name")).agg(F.count("*").alias("f"), F.sum("size").alias("s"))
    mine = folders if names is None else folders.where(names)
    return mine.select("name").join(by, "name", "left").select("name", F.coalesce("f", F.lit(0)).cast("long").alias("used_files"), F.coalesce("s", F.lit(0)).cast("long").alias("used_size"))


def transfer_reset(users: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Users with nothing uploaded or downloaded any more (used_ul, used_dl), those that ``wanted`` admits; others as they are."""
    hit = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    return users.withColumns({c: F.when(hit, F.lit(0)).otherwise(F.col(c)).cast("long") for c in ("used_ul", "used_dl")})


def existing(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Wanted paths, and whether each is there."""
    return wanted.join(files.select("path").distinct().withColumn("found", F.lit(True)), "path", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def zip_estimate(files: DataFrame, by: str, quotas: DataFrame | None = None) -> DataFrame:
    """Size to reserve for an archive: half of the files' bytes. Where ``quotas`` (by, quota_size, used_size) are given, -1 for
    those without a size limit or with nothing left of it: there is no quota to check."""
    sizes = files.groupBy(by).agg(F.floor(F.sum("size") / 2).cast("long").alias("estimate"))
    if quotas is None:
        return sizes
    left = (F.col("quota_size") > 0) & (F.col("used_size") < F.col("quota_size"))
    return sizes.join(quotas.select(by, left.alias("__left")), by, "left").select(by, F.when(F.col("__left"), F.col("estimate")).otherwise(-1).cast("long").alias("estimate"))


def archive_base(files: DataFrame, by: str) -> DataFrame:
    """The parent directory if all files share it, else /."""
    parent = paths.parent(F.col("path"))
    return files.groupBy(by).agg(F.when(F.min(parent) == F.max(parent), F.min(parent)).otherwise("/").alias("base_dir"))


def cron_due(at: Column, hour: str, day_of_month: str, month: str, day_of_week: str) -> Column:
    """Whether ``0 H DoM M DoW`` fires at the hour of a timestamp: ``*``, lists, ranges and ``/`` steps. If both day fields
    are restricted, either may match."""

    def field(spec: str, value: Column, low: int, high: int) -> Column:
        wanted: set[int] = set()
        for part in spec.split(","):
            span, _, step = part.partition("/")
            a, _, z = span.partition("-")
            lo, hi = (low, high) if a == "*" else (int(a), int(z) if z else (high if step else int(a)))
            wanted |= set(range(lo, hi + 1, int(step or 1)))
        return value.isin(sorted(wanted))

    dom, dow = field(day_of_month, F.dayofmonth(at), 1, 31), field(day_of_week.replace("7", "0"), F.dayofweek(at) - 1, 0, 6)
    days = dom | dow if day_of_month[0] != "*" and day_of_week[0] != "*" else dom & dow
    return (F.minute(at) == 0) & field(hour, F.hour(at), 0, 23) & field(month, F.month(at), 1, 12) & days
