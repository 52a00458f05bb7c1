"""Sources: tables by name, adapter views over them, JSON logs, dumps and file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Column expressions of the adapter views, in SQL that reads alike in any engine; ``{us}`` is the microsecond epoch of ts.
FS_EVENTS = {
    "id": "event_id",
    "timestamp": "{us} * 1000",
    "ts_us": "{us}",
    "action": "CASE event_type WHEN 'purchase' THEN 'upload' WHEN 'click' THEN 'download' WHEN 'view' THEN 'rename' WHEN 'signup' THEN 'mkdir' ELSE 'delete' END",
    "username": "concat('user', user_id)",
    "user_id": "user_id",
    "virtual_path": "concat('/', event_type, '/u', user_id, '/f', event_id, CASE WHEN event_id % 3 = 0 THEN '.txt' WHEN event_id % 3 = 1 THEN '.csv' ELSE '.tmp' END)",
    "virtual_target_path": "CASE WHEN event_type = 'view' THEN concat('/archive/f', event_id) ELSE '' END",
    "file_size": "CAST(floor(value * 102400) AS BIGINT)",
    "elapsed": "event_id % 5000 * 977",
    "status": "CASE WHEN event_id % 17 = 0 THEN 3 WHEN event_id % 5 = 0 THEN 2 ELSE 1 END",
    "protocol": "CASE event_id % 4 WHEN 0 THEN 'SFTP' WHEN 1 THEN 'FTP' WHEN 2 THEN 'DAV' ELSE 'HTTP' END",
    "ip": "concat('10.', CAST(floor(user_id / 64) AS BIGINT), '.', user_id % 64, '.', event_id % 5 + 1)",
    "role": "CASE WHEN user_id % 3 = 0 THEN '' ELSE concat('role', user_id % 3) END",
    "instance_id": "concat('node', event_id % 3)",
    "fs_provider": "CAST(event_id % 4 AS INT)",
    "bucket": "CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('bucket', event_id % 7) END",
    "fs_path": "concat('/srv/', event_type, '/', event_id)",
    "fs_target_path": "CASE WHEN event_type = 'view' THEN concat('/srv/archive/', event_id) ELSE '' END",
    "ssh_cmd": "CASE WHEN event_id % 23 = 0 THEN '=scp' ELSE '' END",
}
HOST_EVENTS = {
    "id": "event_id",
    "ts_us": "{us}",
    "ip": "concat('10.0.', user_id % 16, '.', user_id % 200)",
    "event": "CASE event_type WHEN 'error' THEN 'LoginFailed' WHEN 'signup' THEN 'UserNotFound' WHEN 'view' THEN 'NoLoginTried' ELSE 'LimitExceeded' END",
    "protocol": "CASE event_id % 4 WHEN 0 THEN 'SSH' WHEN 1 THEN 'FTP' WHEN 2 THEN 'DAV' ELSE 'HTTP' END",
}
PROVIDER_EVENTS = {
    "id": "o_orderkey",
    "timestamp": "{us} * 1000 + o_orderkey % 3 * 500",
    "action": "CASE o_orderkey % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'update' ELSE 'delete' END",
    "object_type": "CASE o_orderkey % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'folder' WHEN 2 THEN 'group' WHEN 3 THEN 'admin' ELSE 'share' END",
    "object_name": "concat(CASE WHEN o_orderkey % 9 = 0 THEN '=name' ELSE 'name' END, o_custkey)",
    "username": "concat('admin', o_custkey % 10)",
    "ip": "concat('10.1.', o_custkey % 8, '.', o_orderkey % 4)",
    "role": "CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('role', o_custkey % 3) END",
}
LOG_EVENTS = {
    "id": "event_id",
    "timestamp": "{us} * 1000",
    "event": "CAST(event_id % 6 AS INT)",
    "protocol": "CASE event_id % 4 WHEN 0 THEN 'SSH' WHEN 1 THEN 'FTP' WHEN 2 THEN 'DAV' ELSE 'HTTP' END",
    "username": "CASE WHEN event_id % 6 = 3 THEN '' ELSE concat('user', user_id) END",
    "ip": "concat('10.0.', user_id % 16, '.', user_id % 200)",
    "message": "CASE WHEN event_id % 6 = 1 THEN '-denied' ELSE event_type END",
    "role": "CASE WHEN user_id % 3 = 0 THEN '' ELSE concat('role', user_id % 3) END",
}
USERS = {
    "id": "c_custkey",
    "username": "c_name",
    "role_id": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END",
    "status": "CASE WHEN c_custkey % 13 = 0 THEN 0 ELSE 1 END",
    "quota_size": "CASE WHEN c_acctbal <= 0 THEN 0 ELSE CAST(floor(c_acctbal * 1000) AS BIGINT) END",
    "quota_files": "c_custkey % 50",
    "upload_data_transfer": "c_custkey % 5",
    "total_data_transfer": "c_custkey % 3 * 10",
    "created_at": "1700000000000 + c_custkey * 3600000",
    "last_login": "CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 1705000000000 + c_custkey * 1800000 END",
    "expiration_date": "CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1706000000000 + c_custkey * 1000000 END",
    "last_password_change": "1704000000000 + c_custkey * 700000",
    "deleted_at": "CASE WHEN c_custkey % 29 = 0 THEN 1706500000000 + c_custkey ELSE 0 END",
    "updated_at": "1706000000000 + c_custkey * 60000",
    "group_name": "c_mktsegment",
    "nation": "c_nationkey",
}
FILES = {
    "username": "concat('user', page_id % 20)",
    "path": "{path}",
    "size": "{bytes}",
    "mtime_ms": "1700000000000 + page_id * 7200000",
}


def micros(ts: str = "ts") -> str:
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))"


def _view(df: DataFrame, exprs: dict[str, str], **fill: str) -> DataFrame:
    return df.selectExpr(*[f"{v.format(**fill) if fill else v} AS `{k}`" for k, v in exprs.items()])


def fs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(load(spark, sf_dir, "events"), FS_EVENTS, us=micros())


def host_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(load(spark, sf_dir, "events"), HOST_EVENTS, us=micros())


def provider_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(load(spark, sf_dir, "orders"), PROVIDER_EVENTS, us=micros("o_orderdate"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(load(spark, sf_dir, "events"), LOG_EVENTS, us=micros())


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").selectExpr(*[f"{v} AS `{k}`" for k, v in USERS.items()])


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = r"regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/+$', '')"
    return _view(load(spark, sf_dir, "pages"), FILES, path=path, bytes="CAST(octet_length(html) AS BIGINT)")


# ---- logs, dumps, listings ------------------------------------------------------------------------------------------

LOG_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in [("level", T.StringType()), ("time", T.StringType()), ("sender", T.StringType()), ("elapsed_ms", T.LongType()), ("size_bytes", T.LongType()), ("username", T.StringType()), ("file_path", T.StringType()), ("connection_id", T.StringType()), ("protocol", T.StringType()), ("local_addr", T.StringType()), ("remote_addr", T.StringType()), ("client_ip", T.StringType()), ("login_type", T.StringType()), ("error", T.StringType()), ("target_path", T.StringType()), ("ftp_mode", T.StringType())]]
)


def json_log(spark: SparkSession, path: str) -> DataFrame:
    """Structured log lines; a line that is not JSON gives nulls. ``kind`` tells transfers, logins, failures and commands apart."""
    rows = spark.read.schema(LOG_SCHEMA).json(path)
    kind = F.when(F.col("sender").isin("Upload", "Download"), "transfer").when(F.col("sender") == "login", "login").when(F.col("sender") == "connection_failed", "failed").when(F.col("sender").isNotNull(), "command")
    return rows.withColumn("kind", kind)


#: Fixed value: dumps older than this spell placeholders without a leading dot.
DOTTED_SINCE = 17
ENTITIES = ["users", "groups", "folders", "admins", "api_keys", "shares", "event_actions", "event_rules", "roles", "ip_lists", "configs"]


def read_dump(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A JSON dump as a frame for each entity it holds; placeholders of old dumps get their dot."""
    whole = spark.read.option("multiLine", True).json(path)
    out = {}
    version = F.col("version") if "version" in whole.columns else F.lit(DOTTED_SINCE)
    for e in ENTITIES:
        if e in whole.columns and isinstance(whole.schema[e].dataType, T.ArrayType):
            rows = whole.select(version.alias("__v"), F.explode(e).alias("r"))
            if e == "event_actions":
                text = F.to_json("r")
                fixed = F.when(F.col("__v") < DOTTED_SINCE, F.regexp_replace(text, r"\{\{(\w+)\}\}", "{{.$1}}")).otherwise(text)
                rows = rows.select(F.from_json(fixed, rows.schema["r"].dataType).alias("r"))
            out[e] = rows.select("r.*")
    return out


def listing(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, size, mtime_ms of the files below a folder; contents are not read. Works on whatever store Spark reads."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"))


def store_listing(keys: DataFrame, prefix: str) -> DataFrame:
    """One level of an object store: objects directly below the prefix, and pseudo-directories, each once. keys: key, size."""
    rest = F.substring(F.col("key"), F.lit(len(prefix) + 1), F.length("key"))
    below = keys.where(F.startswith("key", F.lit(prefix))).withColumn("rest", rest).where("rest <> ''")
    name, is_dir = F.element_at(F.split("rest", "/"), 1), F.contains("rest", F.lit("/"))
    return below.select(name.alias("name"), is_dir.alias("is_dir"), F.when(~is_dir, F.col("size")).otherwise(0).alias("size")).groupBy("name", "is_dir").agg(F.max("size").alias("size"))


def walk(entries: DataFrame, root: str) -> DataFrame:
    """All entries at or below root. entries: path, ..."""
    under = root.rstrip("/") + "/"
    return entries.where((F.col("path") == root) | F.startswith("path", F.lit(under)))


def connections(snapshot: DataFrame, role: str = "") -> DataFrame:
    """Live connections, a row for each transfer (and for connections without one); only a role's where one is given."""
    rows = snapshot.where(F.col("role") == role) if role else snapshot
    return rows.withColumn("transfer", F.explode_outer("transfers")).drop("transfers")


#: Fixed values of encrypted files: bytes of the header, of a package's payload and of what is added to each payload.
CRYPT_HEADER, CRYPT_PAYLOAD, CRYPT_ADDED = 33, 65536, 32


def decrypted_size(size: Column) -> Column:
    """Plain bytes of an encrypted file's length. A length that no such file has counts without its header; below it, as 0."""
    body, package = size - CRYPT_HEADER, CRYPT_PAYLOAD + CRYPT_ADDED
    last = F.pmod(body, F.lit(package))
    plain = F.floor(body / package) * CRYPT_PAYLOAD + F.when(last > 0, last - CRYPT_ADDED).otherwise(0)
    return F.when(body < 0, 0).when((last > 0) & (last <= CRYPT_ADDED), body).otherwise(plain).cast("long")


def encrypted_listing(files: DataFrame) -> DataFrame:
    """A listing of encrypted files with the sizes of their plain contents."""
    return files.withColumn("size", decrypted_size(F.col("size")))


LISTED = "root string, name string, size long, is_dir boolean, mtime_ms long"


def remote_listing(roots: DataFrame, lister) -> DataFrame:
    """Directories on servers that Spark has no file system for, a row for each entry. roots: root, spread over partitions by
    the caller; lister(root) yields dicts of name, size, is_dir, mtime_ms and runs on the executors, a directory at a time."""

    def run(frames):
        import pandas as pd

        for f in frames:
            for root in f["root"]:
                rows = [{"root": root, **e} for e in lister(root)]
                if rows:
                    yield pd.DataFrame(rows)[["root", "name", "size", "is_dir", "mtime_ms"]]

    return roots.select("root").mapInPandas(run, LISTED)


#: Fixed value: the bit of a file mode that marks directories in HTTP listings.
MODE_DIR = 1 << 31


def http_lister(endpoint: str, api_key: str = "", timeout: float = 30):
    """A lister for servers that answer GET <endpoint>/readdir/<path> with a JSON list of name, size, mode, last_modified."""

    def lister(root: str):
        import json
        from datetime import datetime
        from urllib.parse import quote
        from urllib.request import Request, urlopen

        request = Request(f"{endpoint}/readdir/{quote(root, safe='')}", headers={"X-API-KEY": api_key} if api_key else {})
        with urlopen(request, timeout=timeout) as answer:
            for e in json.load(answer):
                at = datetime.fromisoformat(e["last_modified"].replace("Z", "+00:00"))
                yield {"name": e["name"], "size": e["size"], "is_dir": bool(e["mode"] & MODE_DIR), "mtime_ms": int(at.timestamp() * 1000)}

    return lister
