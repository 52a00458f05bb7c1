"""Aggregations: scores, tree sizes, transfers, quota folds and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

MB = 1048576
#: Default scores of host events.
SCORES = {"LoginFailed": 1, "UserNotFound": 2, "NoLoginTried": 0, "LimitExceeded": 3}


def event_score(event: Column, scores: dict[str, int] | None = None) -> Column:
    out = F.lit(0)
    for k, v in (scores or SCORES).items():
        out = F.when(event == k, v).otherwise(out)
    return out


def host_scores(events: DataFrame, since_us: int) -> DataFrame:
    """Total score of every host since then; hosts at 0 drop out."""
    return events.where(F.col("ts_us") >= since_us).groupBy("ip").agg(F.sum(event_score(F.col("event"))).cast("long").alias("score")).where("score > 0")


def host_listing(hosts: DataFrame, events: DataFrame, since_us: int, now_us: int) -> DataFrame:
    """Known hosts with their score since then and, while it lasts, their ban; hosts with neither drop out. hosts: ip, ban_us (end
    of the ban, null or 0 without). Scores are summed before the join."""
    ban = F.when(F.col("ban_us") > now_us, F.col("ban_us"))
    scored = hosts.select("ip", ban.alias("ban_us")).join(host_scores(events, since_us), "ip", "left")
    return scored.select("ip", "ban_us", F.coalesce("score", F.lit(0)).cast("long").alias("score")).where("score > 0 OR ban_us IS NOT NULL")


def sliding_scores(events: DataFrame, window_us: int, inclusive: bool = False) -> DataFrame:
    """Each event with its host's total over the window that ends with it; an event exactly a window old counts only if inclusive."""
    w = Window.partitionBy("ip").orderBy("ts_us").rangeBetween(-window_us + (0 if inclusive else 1), 0)
    return events.withColumn("score", F.sum(event_score(F.col("event"))).over(w).cast("long"))


def tree_usage(files: DataFrame, by: list[str]) -> DataFrame:
    """Files and bytes below every directory, counted at each level; directory markers (names ending in /) do not count."""
    real = files.where(~F.endswith("path", F.lit("/")))
    up = real.select(*by, "size", F.explode(paths.ancestors(paths.parent(F.col("path")))).alias("dir"))
    return up.groupBy(*by, "dir").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


def user_usage(home: DataFrame, folders: DataFrame) -> DataFrame:
    """Home files plus those of folders counted in the user's quota (both limits -1). home: username, size; folders: username,
    size, quota_size, quota_files."""
    inside = folders.where((F.col("quota_size") == -1) & (F.col("quota_files") == -1))
    return home.select("username", "size").unionByName(inside.select("username", "size")).groupBy("username").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


def upload_totals(transfers: DataFrame) -> DataFrame:
    """Growth of uploads by user and folder; only keys with more than one. transfers: username, folder, kind, ul, truncated."""
    up = transfers.where(F.col("kind") == "upload").groupBy("username", "folder")
    return up.agg(F.count("*").alias("transfers"), F.sum(F.col("ul") - F.col("truncated")).cast("long").alias("growth")).where("transfers > 1")


def user_transfers(transfers: DataFrame) -> DataFrame:
    """Bytes moved by user; only users with more than one transfer."""
    return transfers.groupBy("username").agg(F.count("*").alias("transfers"), F.sum("ul").cast("long").alias("sum_ul"), F.sum("dl").cast("long").alias("sum_dl")).where("transfers > 1")


def transfer_exceeded(limits: dict[str, Column], used: dict[str, Column], current: dict[str, Column], sums: dict[str, Column]) -> Column:
    """Data-transfer limit (MB; total before direction; 0 is none) passed, by a transfer that made progress itself."""
    over = lambda n, limit: n > limit * MB
    moved = (current["ul"] > 0) | (current["dl"] > 0)
    total = (limits["total"] > 0) & over(used["ul"] + used["dl"] + sums["ul"] + sums["dl"], limits["total"]) & moved
    dl = (limits["dl"] > 0) & over(used["dl"] + sums["dl"], limits["dl"]) & (current["dl"] > 0)
    ul = (limits["ul"] > 0) & over(used["ul"] + sums["ul"], limits["ul"]) & (current["ul"] > 0)
    return F.when(limits["total"] > 0, total).otherwise(dl | ul)


def overquota(transfers: DataFrame, users: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Transfers to stop: uploads that have grown, of a user and folder whose uploads together grow past the quota left, or
    whose user passes a transfer limit. A user with a single transfer is never looked at. The quota is the folder's where
    ``folders`` (folder, quota_size, used_size) has one of its own (-1: the user's). users: username, quota_size, used_size,
    limit_total, limit_ul, limit_dl, used_ul, used_dl. Sums by user and folder are joined back, so a user's transfers need not
    meet in one task."""
    mine = transfers.groupBy("username").agg(F.count("*").alias("n"), F.sum("ul").alias("sum_ul"), F.sum("dl").alias("sum_dl")).where("n > 1").join(users, "username")
    up = transfers.where("kind = 'upload'").groupBy("username", "folder").agg(F.count("*").alias("n_folder"), F.sum(F.col("ul") - F.col("truncated")).alias("growth")).where("n_folder > 1")
    t = transfers.join(mine, "username").join(up.withColumnsRenamed({"username": "__u", "folder": "__f"}), (F.col("username") == F.col("__u")) & F.col("folder").eqNullSafe(F.col("__f")), "left")
    quota, used = F.col("quota_size"), F.col("used_size")
    if folders is not None:
        t = t.join(folders.select(F.col("folder").alias("__g"), F.col("quota_size").alias("__q"), F.col("used_size").alias("__s")), F.col("folder") == F.col("__g"), "left")
        own = F.col("__q").isNotNull() & (F.col("__q") != -1)
        quota, used = F.when(own, F.col("__q")).otherwise(quota), F.when(own, F.col("__s")).otherwise(used)
    disk = (F.col("kind") == "upload") & (quota > 0) & (F.col("growth") > quota - used) & (F.col("ul") > F.col("truncated"))
    moved = transfer_exceeded(
        {k: F.col(f"limit_{k}") for k in ("total", "ul", "dl")}, {k: F.col(f"used_{k}") for k in ("ul", "dl")}, {k: F.col(k) for k in ("ul", "dl")}, {k: F.col(f"sum_{k}") for k in ("ul", "dl")}
    )
    reason = F.when(disk, "disk").when(F.coalesce(moved, F.lit(False)), "transfer")
    return t.withColumn("reason", reason).where("reason is not null").select(*transfers.columns, "reason")


def coalesce_deltas(deltas: DataFrame, key: str = "key") -> DataFrame:
    """Net change by key; keys without one vanish."""
    return deltas.groupBy(key).agg(F.sum("files").cast("long").alias("files"), F.sum("size").cast("long").alias("size")).where("files <> 0 OR size <> 0")


def fold_resets(deltas: DataFrame, key: str = "key") -> DataFrame:
    """Value by key: the last reset and what was added after it. deltas: key, ts, seq, files, size, is_reset."""
    w = Window.partitionBy(key).orderBy(F.col("ts"), F.col("seq"))
    era = F.sum(F.col("is_reset").cast("int")).over(w)
    last = F.max("era").over(Window.partitionBy(key))
    return deltas.withColumn("era", era).withColumn("last", last).where("era = last").groupBy(key).agg(F.sum("files").cast("long").alias("files"), F.sum("size").cast("long").alias("size"))


def first_event(events: DataFrame, by: list[str], when: str) -> DataFrame:
    return events.groupBy(*by).agg(F.min(when).alias("first_us"))


def evict(rows: DataFrame, key: str, hard: int, soft: int) -> DataFrame:
    """Kept rows: all up to the hard limit; beyond it only the ``soft`` most recent. key: recency."""
    n = rows.count()
    return rows if n <= hard else rows.orderBy(F.col(key).desc(), *[F.col(c) for c in rows.columns if c != key]).limit(soft)


def within_bytes(rows: DataFrame, size: str, recency: str, cap: int, by: list[str]) -> DataFrame:
    """Rows kept when the oldest go until the bytes fit; per key."""
    w = Window.partitionBy(*by).orderBy(F.col(recency).desc(), F.col(size)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__b", F.sum(size).over(w)).where(F.col("__b") <= cap).drop("__b")


def transfer_counters(events: DataFrame) -> DataFrame:
    """Counters of transfers, commands and bytes by protocol; bytes count whether the transfer succeeded or not."""
    up, down, ok = F.col("action") == "upload", F.col("action") == "download", F.col("status") == 1
    other = ~up & ~down
    return events.groupBy("protocol").agg(
        F.count_if(up & ok).alias("uploads_total"), F.count_if(up & ~ok).alias("upload_errors_total"), F.coalesce(F.sum(F.when(up, F.col("file_size"))), F.lit(0)).cast("long").alias("upload_size"),
        F.count_if(down & ok).alias("downloads_total"), F.count_if(down & ~ok).alias("download_errors_total"), F.coalesce(F.sum(F.when(down, F.col("file_size"))), F.lit(0)).cast("long").alias("download_size"),
        F.count_if(other & ok).alias("commands_total"), F.count_if(other & ~ok).alias("command_errors_total"),
    )


#: Store providers with counters of their own, and their transfer and object counters.
STORES = {1: "s3", 2: "gcs", 3: "az", 5: "sftpfs", 6: "httpfs"}


def store_counters(events: DataFrame) -> DataFrame:
    """The same counters for every object store."""
    name = F.lit(None).cast("string")
    for k, v in STORES.items():
        name = F.when(F.col("fs_provider") == k, v).otherwise(name)
    ok = F.col("status") == 1
    named = events.withColumn("store", name).where("store is not null")
    cols = [f(c).alias(n) for a, c in (("upload", F.col("action") == "upload"), ("download", F.col("action") == "download"), ("delete", F.col("action") == "delete"), ("copy", F.col("action") == "copy"), ("list", F.col("action") == "list"), ("head", F.col("action") == "head")) for n, f in ((f"{a}_total", lambda c: F.count_if(c & ok)), (f"{a}_errors", lambda c: F.count_if(c & ~ok)))]
    return named.groupBy("store").agg(*cols, F.coalesce(F.sum(F.when(F.col("action") == "upload", F.col("file_size"))), F.lit(0)).cast("long").alias("upload_size"), F.coalesce(F.sum(F.when(F.col("action") == "download", F.col("file_size"))), F.lit(0)).cast("long").alias("download_size"))


#: Login methods with counters of their own; anything else counts as a password.
LOGIN_METHODS = {"publickey": "public_key", "keyboard-interactive": "keyboard_interactive", "publickey+password": "key_and_password", "publickey+keyboard-interactive": "key_and_keyboard_int", "TLSCertificate": "tls_cert", "TLSCertificate+password": "tls_cert_and_pwd", "IDP": "idp"}


def login_counters(logins: DataFrame) -> DataFrame:
    """Attempts, successes and failures by login method. logins: method, ok."""
    bucket = F.lit("password")
    for k, v in LOGIN_METHODS.items():
        bucket = F.when(F.col("method") == k, v).otherwise(bucket)
    return logins.groupBy(bucket.alias("method")).agg(F.count("*").alias("attempts"), F.count_if("ok").alias("login_ok"), F.count_if(~F.col("ok")).alias("login_ko"))


def http_counters(requests: DataFrame) -> DataFrame:
    """requests: status."""
    from ..functions import text

    return requests.groupBy(text.http_class(F.col("status")).alias("class")).agg(F.count("*").alias("requests"))


def per_client(connections: DataFrame) -> DataFrame:
    return connections.groupBy("ip").agg(F.count("*").alias("connections"))


def admitted(requests: DataFrame, clients: DataFrame, max_total: int, max_per_host: int, listed: Column | None = None, safe: Column | None = None, connections: int = 0, transfers: int = 0, sessions: int = 0) -> DataFrame:
    """Which new connections are let in. Where there is an allow list, only hosts on it (``listed``); these too meet the caps (0:
    no cap): a host's own connections may not exceed max_per_host unless it is ``safe``, all connections may not exceed
    max_total, and transfers and sessions must be below it."""
    r = requests.join(clients, "ip", "left").withColumn("connections", F.coalesce("connections", F.lit(0)))
    host = F.lit(max_per_host <= 0) | (F.col("connections") <= max_per_host) | (safe if safe is not None else F.lit(False))
    whole = max_total <= 0 or (connections <= max_total and transfers < max_total and sessions < max_total)
    return r.withColumn("allowed", (listed if listed is not None else F.lit(True)) & host & F.lit(whole))


def idle(connections: DataFrame, now_ms: int, timeout_ms: int, login_timeout_ms: int | None = None) -> DataFrame:
    """Connections to close (column reason). SSH parents (kind ssh) past the timeout, unless a connection of theirs has been active
    within it. Others past the timeout, or past the login timeout if they are FTP and have no user yet, are idle; those of a
    user who may no longer log in (allowed false) are refused. connections: id, kind, parent_id, protocol, username,
    last_activity, allowed."""
    age, parent = F.lit(now_ms) - F.col("last_activity"), F.col("kind") == "ssh"
    live = connections.where(~parent & F.col("parent_id").isNotNull() & (age <= timeout_ms)).select(F.col("parent_id").alias("id"), F.lit(True).alias("__live")).distinct()
    guest = (F.col("protocol") == "FTP") & (F.col("username") == "")
    late = (age > timeout_ms) | (guest & (age > (timeout_ms if login_timeout_ms is None else login_timeout_ms)))
    reason = F.when(parent, F.when((age > timeout_ms) & F.col("__live").isNull(), "idle")).when(late, "idle").when(~guest & ~F.col("allowed"), "access")
    return connections.join(live, "id", "left").withColumn("reason", reason).where("reason is not null").select(*connections.columns, "reason")


def failures(results: DataFrame, key: str) -> DataFrame:
    """One message a run, with the names that failed in order. results: key, name, ok."""
    return results.where(~F.col("ok")).groupBy(key).agg(F.concat_ws(", ", F.array_sort(F.collect_list("name"))).alias("failed"))
