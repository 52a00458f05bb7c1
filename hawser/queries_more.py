"""Further queries: decisions about access, sessions, files and accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import net, paths, text
from .operators import aggregates, caches, checks, dml, joins, policy, search
from .plans import accounts
from .queries import _SINCE, AS_OF, FILES_SQL, FS_SQL, HOST_SQL, SCORE_SQL, USERS_SQL, _cte, _RETAIN_SQL, _policies, query
from .sinks import actions, export
from .sources import tables


@query("""SELECT o_orderkey AS share, (o_orderkey % 5 = 0 OR o_custkey % 7 < o_orderkey % 5) AND (o_orderkey % 3 = 0 OR 1706745600000 - 1000 + o_orderkey >= 1706745600000)
    AND (o_orderkey % 2 = 0 OR o_custkey % 4 = 1) AS usable FROM orders""")
def share_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = tables.load(spark, sf_dir, "orders").select(
        k.alias("share"), (k % 5).alias("max_tokens"), (c % 7).alias("used_tokens"), F.when(k % 3 == 0, 0).otherwise(AS_OF - 1000 + k).alias("expires_at"),
        F.when(k % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("nonsense"), F.lit("10.0.1.0/24"))).alias("allow_from"), F.concat(F.lit("10.0."), c % 4, F.lit(".9")).alias("ip"),
    )
    return o.select("share", policy.share_usable(F.lit(AS_OF), F.col("ip")).alias("usable"))


@query(f"""WITH {FS_SQL} SELECT id, virtual_path AS path, starts_with(virtual_path, '/error/u1/') OR NOT ends_with(virtual_path, '.tmp') AS allowed
    FROM fs WHERE NOT starts_with(virtual_path, '/error/') OR starts_with(virtual_path, '/error/u1/')""")
def file_pattern_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [{"path": "/", "denied": ["*.tmp"]}, {"path": "/error", "allowed": ["*.TXT"], "hide": True}, {"path": "/error/u1"}]
    return policy.visible(tables.fs_events(spark, sf_dir).select("id", F.col("virtual_path").alias("path")), rules)


@query(f"WITH {FILES_SQL}, e AS (SELECT DISTINCT path FROM files) SELECT path, false AS mount FROM e WHERE path NOT IN ('/en/1', '/en/25') UNION ALL SELECT * FROM (VALUES ('/en/1', true), ('/en/25', true)) t(path, mount)")
def listing_with_mounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.files(spark, sf_dir).select("path", F.lit(False).alias("mount")).distinct()
    return joins.shadowed(e, spark.createDataFrame([("/en/1", True), ("/en/25", True)], "path string, mount boolean"))


@query(f"WITH {FS_SQL} SELECT id, CASE WHEN user_id % 3 > 0 THEN user_id % 3 * 1048576 - file_size > 0 WHEN user_id % 2 > 0 THEN 2097152 - file_size > 0 ELSE true END AS room FROM fs WHERE action = 'upload'")
def transfer_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    room = policy.has_upload_space(u % 2 * 2097152, F.col("file_size"), u % 3 * 1048576, F.col("file_size"))
    return tables.fs_events(spark, sf_dir).where("action = 'upload'").select("id", room.alias("room"))


@query(f"WITH {HOST_SQL}, c AS (SELECT ip, count(*) AS n FROM host GROUP BY ip) SELECT ip, string_split(ip, '.')[3]::INT < 12 AND (n <= 60 OR starts_with(ip, '10.0.7.')) AS allowed FROM c")
def connection_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.host_events(spark, sf_dir)
    clients = aggregates.per_client(e)
    listed = net.in_any(F.col("ip"), F.array(F.lit("10.0.0.0/21"), F.lit("10.0.8.0/22")))
    return aggregates.admitted(clients.select("ip"), clients, 100, 60, listed, net.in_cidr(F.col("ip"), F.lit("10.0.7.0/24")), connections=100, transfers=99).select("ip", "allowed")


_SESSIONS = {"id": "event_id", "kind": "CASE WHEN event_id % 6 = 0 THEN 'ssh' ELSE 'session' END", "parent_id": "CASE WHEN event_id % 6 = 1 THEN event_id - 1 WHEN event_id % 6 = 2 THEN event_id - 2 END", "protocol": "CASE WHEN event_id % 6 < 3 THEN 'SFTP' ELSE 'FTP' END", "username": "CASE WHEN event_id % 6 = 3 THEN '' ELSE 'u' END", "last_activity": "{us} {div} 1000", "allowed": "event_id % 13 <> 0"}
_SESSIONS_SQL = "s AS (SELECT " + ", ".join(f"{v.format(us='epoch_us(ts)', div='//')} AS {k}" for k, v in _SESSIONS.items()) + " FROM events)"


@query(f"""WITH {_SESSIONS_SQL}, o AS (SELECT *, 1706600000000 - last_activity AS age FROM s), r AS (SELECT id, last_activity, CASE
      WHEN kind = 'ssh' THEN CASE WHEN age > 900000000 AND id NOT IN (SELECT parent_id FROM o WHERE kind <> 'ssh' AND age <= 900000000 AND parent_id IS NOT NULL) THEN 'idle' END
      WHEN age > 900000000 OR (protocol = 'FTP' AND username = '' AND age > 100000000) THEN 'idle' WHEN NOT (protocol = 'FTP' AND username = '') AND NOT allowed THEN 'access' END AS reason FROM o)
    SELECT * FROM r WHERE reason IS NOT NULL""")
def idle_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.load(spark, sf_dir, "events").selectExpr(*[f"{v.format(us=tables.micros(), div='div')} AS `{k}`" for k, v in _SESSIONS.items()])
    return aggregates.idle(e, 1706600000000, 900_000_000, 100_000_000).select("id", "last_activity", "reason")


@query(f"{_RETAIN_SQL}, left_ AS (SELECT DISTINCT dir FROM up WHERE n < len(parts) AND path NOT IN (SELECT path FROM del)) SELECT DISTINCT dir FROM up WHERE n < len(parts) AND dir <> '/' AND path IN (SELECT path FROM del) AND dir NOT IN (SELECT dir FROM left_)")
def emptied_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.files(spark, sf_dir)
    return checks.emptied(f, checks.retention(f, _policies(spark), AS_OF))


@query(f"WITH {FILES_SQL}, p AS (SELECT username, CASE WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS d FROM files) SELECT username, CASE WHEN min(d) = max(d) THEN min(d) ELSE '/' END AS base_dir FROM p GROUP BY 1")
def archive_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.archive_base(tables.files(spark, sf_dir), "username")


@query(f"WITH {FS_SQL} SELECT id, greatest(1000 * (file_size // 1024) // (64 + id % 3 * 64) - elapsed // 100, 0)::BIGINT AS wait_ms FROM fs")
def throttle_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    wait = text.throttle_wait_ms(F.col("file_size"), 64 + F.col("id") % 3 * 64, F.floor(F.col("elapsed") / 100).cast("long"))
    return tables.fs_events(spark, sf_dir).select("id", wait.alias("wait_ms"))


@query(f"WITH {FS_SQL} SELECT id, starts_with(virtual_path, '/error/u1/') OR virtual_path = '/error/u1' AS overlaps, starts_with(virtual_path, '/view') OR starts_with(virtual_path, '/cl') AS listed FROM fs")
def path_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("virtual_path")
    return tables.fs_events(spark, sf_dir).select("id", paths.overlaps(p, F.lit("/error/u1")).alias("overlaps"), paths.has_prefix_in(p, F.array(F.lit("/view"), F.lit("/cl"))).alias("listed"))


@query(f"WITH {HOST_SQL} SELECT id, CASE WHEN starts_with(ip, '10.0.3.') AND protocol IN ('SSH', 'FTP') THEN 'safe' WHEN starts_with(ip, '10.0.') AND string_split(ip, '.')[3]::INT < 8 THEN 'denied' ELSE 'scored' END AS verdict FROM host")
def safe_list_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = spark.createDataFrame([("10.0.0.0/21", 2, 0), ("10.0.3.0/24", 1, 3)], "cidr string, mode int, protocols int")
    return joins.screened(tables.host_events(spark, sf_dir), lists).select("id", "verdict")


_CLOSED = {"id": "event_id", "username": "concat('user', user_id)", "path": "concat('/f', event_id % 50)", "kind": "CASE WHEN event_id % 2 = 0 THEN 'upload' ELSE 'download' END", "bytes": "CAST(floor(value * 1000) AS BIGINT)", "old_size": "CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1000 END", "error": "CASE WHEN event_type = 'error' THEN 'broken' ELSE '' END", "quota_exceeded": "event_id % 19 = 0"}
_CLOSED_SQL = "t AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _CLOSED.items()) + " FROM events)"


@query(f"WITH {_CLOSED_SQL} SELECT username AS key, count_if(old_size = 0) AS files, sum(bytes - old_size)::BIGINT AS size FROM t WHERE kind = 'upload' GROUP BY 1 HAVING count_if(old_size = 0) <> 0 OR sum(bytes - old_size) <> 0")
def transfer_close_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.load(spark, sf_dir, "events").selectExpr(*[f"{v} AS `{k}`" for k, v in _CLOSED.items()])
    return accounts.closed_transfers(t, 0)[1]


@query(f"WITH {_CLOSED_SQL} SELECT id, kind AS action, path AS virtual_path, CASE WHEN quota_exceeded THEN 3 WHEN error <> '' THEN 2 ELSE 1 END AS status FROM t")
def transfer_close_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.load(spark, sf_dir, "events").selectExpr(*[f"{v} AS `{k}`" for k, v in _CLOSED.items()])
    return accounts.closed_transfers(t, 0)[0].select("id", "action", "virtual_path", "status")


@query("SELECT s_name AS username, concat('/data/', s_name) AS home_dir FROM supplier UNION ALL SELECT c_name, '/old' FROM customer WHERE c_name NOT IN (SELECT s_name FROM supplier)")
def login_account_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = tables.users(spark, sf_dir).select("username", F.lit("/old").alias("home_dir"))
    logins = tables.load(spark, sf_dir, "supplier").select(F.col("s_name").alias("Name"))
    return accounts.accounts_from_login(logins, users, '{"username": "{{.Name}}", "home_dir": "/data/{{.Name}}"}', "username string, home_dir string", 0)


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 6 ELSE 5 END AS version, CASE WHEN s_suppkey % 3 = 0 THEN 99 ELSE 1 END AS updated_at FROM supplier")
def versioned_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    table = s.withColumn("version", F.lit(5)).withColumn("updated_at", F.lit(1))
    change = s.withColumn("expected", F.when(F.col("id") % 3 == 0, 5).otherwise(4)).withColumn("updated_at", F.lit(99))
    return dml.compare_and_set(table, change, "id")


@query(f"WITH {USERS_SQL} SELECT id, CASE WHEN nation IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) THEN {AS_OF} ELSE updated_at END AS updated_at FROM users")
def cascading_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = tables.users(spark, sf_dir)
    changed = tables.load(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("nation"))
    return dml.touch(u.select("id", "updated_at"), u.select("id", "nation"), changed, "id", AS_OF).select("id", "updated_at")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE coalesce((SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey), 0) END AS first_upload FROM customer")
def first_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = tables.users(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, 5).otherwise(0).cast("long").alias("first_upload"))
    seen = tables.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("first_upload"))
    return dml.first_write(old, seen, "id", "first_upload")


@query("SELECT n_name AS run, string_agg(s_name, ', ' ORDER BY s_name) AS failed FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 = 1 GROUP BY 1")
def failure_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("run"))
    r = tables.load(spark, sf_dir, "supplier").join(n, "s_nationkey").select("run", F.col("s_name").alias("name"), (F.col("s_suppkey") % 4 != 1).alias("ok"))
    return aggregates.failures(r, "run")


@query(f"WITH {FILES_SQL}, h AS (SELECT username, size FROM files UNION ALL SELECT concat('user', l_suppkey % 20), CAST(l_quantity AS BIGINT) FROM lineitem WHERE l_linenumber % 2 = 0) SELECT username, count(*) AS files, sum(size)::BIGINT AS bytes FROM h GROUP BY 1")
def user_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    quota = F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(F.col("l_linenumber"))
    folders = tables.load(spark, sf_dir, "lineitem").select(F.concat(F.lit("user"), F.col("l_suppkey") % 20).alias("username"), F.col("l_quantity").cast("long").alias("size"), quota.alias("quota_size"), F.lit(-1).alias("quota_files"))
    return aggregates.user_usage(tables.files(spark, sf_dir), folders)


@query(f"WITH {FILES_SQL}, r AS (SELECT *, sum(size) OVER (PARTITION BY username ORDER BY mtime_ms DESC, size ROWS UNBOUNDED PRECEDING) AS b FROM files) SELECT username, path, size FROM r WHERE b <= 30000")
def cache_eviction_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.within_bytes(tables.files(spark, sf_dir), "size", "mtime_ms", 30_000, ["username"]).select("username", "path", "size")


@query(f"WITH {HOST_SQL}, c AS (SELECT ip, count(*) AS n FROM host GROUP BY 1) SELECT concat('connections{{ip=\"', ip, '\"}} ', n) AS line FROM c")
def metrics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.metrics(aggregates.per_client(tables.host_events(spark, sf_dir)), "ip")


@query("SELECT o_orderkey AS id FROM orders WHERE (day(o_orderdate) BETWEEN 1 AND 7 OR dayofweek(o_orderdate) = 1) AND month(o_orderdate) % 3 = 1")
def cron_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.load(spark, sf_dir, "orders")
    return o.where(checks.cron_due(F.col("o_orderdate"), "*/12", "1-7", "*/3", "1")).select(F.col("o_orderkey").alias("id"))


@query("SELECT c_custkey AS id, concat_ws(',', 'own', CASE WHEN c_custkey % 2 = 0 THEN concat('p', c_nationkey) END, CASE WHEN c_custkey % 3 = 0 THEN concat('s', c_nationkey % 2) END) AS merged FROM customer")
def group_lists_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    group = lambda kind, order, on, v: F.struct(F.when(on, kind).otherwise(3).alias("type"), F.lit(order).alias("sort_order"), F.array(v, F.lit("own")).alias("values"))
    groups = F.array(group(2, 1, k % 3 == 0, F.concat(F.lit("s"), n % 2)), group(1, 2, k % 2 == 0, F.concat(F.lit("p"), n)))
    return tables.load(spark, sf_dir, "customer").select(k.alias("id"), F.array_join(policy.apply_groups(F.array(F.lit("own")), groups), ",").alias("merged"))


@query("SELECT c_custkey AS id, 'list' AS home, CASE WHEN c_custkey % 2 = 0 THEN 'mine' ELSE 'group' END AS docs, 'group' AS pub FROM customer")
def group_maps_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("/"), F.lit("*"), F.lit("/docs"), F.lit("mine"))).otherwise(F.create_map(F.lit("/"), F.lit("*")))
    group = F.create_map(F.lit("/"), F.lit("list"), F.lit("/docs"), F.lit("group"), F.lit("/pub"), F.lit("group"))
    merged = policy.merge_maps(own, group, primary=True)
    return tables.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), merged["/"].alias("home"), merged["/docs"].alias("docs"), merged["/pub"].alias("pub"))


@query(f"WITH {FS_SQL} SELECT count(*) AS n, count(DISTINCT username) AS users FROM fs")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.fs_events(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct("username").alias("users"))


@query(f"WITH {USERS_SQL} SELECT id, username FROM users WHERE username > 'Customer#000000020' AND starts_with(username, 'Customer#0000000') ORDER BY username LIMIT 30")
def name_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyset(tables.users(spark, sf_dir).select("id", "username"), "username", after="Customer#000000020", prefix="Customer#0000000", limit=30)


# ---- changes to objects, log events ---------------------------------------------------------------------------------

PROVIDER_SQL = _cte("ev", tables.PROVIDER_EVENTS, "orders", us="epoch_us(o_orderdate)")
LOG_SQL = _cte("ev", tables.LOG_EVENTS, "events", us="epoch_us(ts)")


@query(f"""WITH {PROVIDER_SQL} SELECT id, strftime(make_timestamp(timestamp // 1000), '%Y-%m-%dT%H:%M:%S') || CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN '.0000005' ELSE '.000001' END || 'Z' AS time, action, object_type,
    CASE WHEN starts_with(object_name, '=') THEN '''' || object_name ELSE object_name END AS object_name, username AS user, ip, role FROM ev""")
def provider_event_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.provider_export(tables.provider_events(spark, sf_dir))


@query(f"""WITH {LOG_SQL} SELECT id, strftime(make_timestamp(timestamp // 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN timestamp // 1000 % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad((timestamp // 1000 % 1000000)::VARCHAR, 6, '0'), '0') END || 'Z' AS time,
    CASE event WHEN 1 THEN 'Login failed' WHEN 2 THEN 'Login with non-existent user' WHEN 3 THEN 'No login tried' WHEN 4 THEN 'Algorithm negotiation failed' WHEN 5 THEN 'Login succeeded' ELSE '' END AS event,
    protocol, username AS user, ip, CASE WHEN message = '-denied' THEN '''-denied' ELSE message END AS message, role FROM ev""")
def log_event_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.log_export(tables.log_events(spark, sf_dir))


@query(f"WITH {PROVIDER_SQL} SELECT id, timestamp, action, object_type, object_name, username FROM ev WHERE action IN ('add', 'update') AND object_type IN ('user', 'admin') AND role = 'role1' ORDER BY timestamp, id LIMIT 200")
def provider_event_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = search.EventFilter(among={"action": ["add", "update"], "object_type": ["user", "admin"]}, order="ASC", limit=200, role="role2").scoped("role1")
    return search.search_events(tables.provider_events(spark, sf_dir), f).select("id", "timestamp", "action", "object_type", "object_name", "username")


@query(f"WITH {LOG_SQL} SELECT id, timestamp, event, protocol, username, ip FROM ev WHERE event IN (1, 2, 5) AND protocol IN ('SSH', 'HTTP') ORDER BY timestamp DESC, id DESC LIMIT 300")
def log_event_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = search.EventFilter(among={"event": [1, 2, 5], "protocol": ["SSH", "HTTP"]}, limit=300)
    return search.search_events(tables.log_events(spark, sf_dir), f).select("id", "timestamp", "event", "protocol", "username", "ip")


@query(f"""WITH {HOST_SQL}, hosts AS (SELECT concat('10.0.', c_custkey % 16, '.', c_custkey % 200) AS ip, max(CASE c_custkey % 5 WHEN 0 THEN {_SINCE} + c_custkey WHEN 1 THEN 0 END) AS ban FROM customer GROUP BY 1),
    s AS (SELECT ip, sum({SCORE_SQL})::BIGINT AS score FROM host WHERE ts_us >= {_SINCE} GROUP BY 1)
    SELECT ip, CASE WHEN ban > {_SINCE} + 50 THEN ban END AS ban_us, coalesce(score, 0) AS score FROM hosts LEFT JOIN s USING (ip) WHERE coalesce(score, 0) > 0 OR ban > {_SINCE} + 50""")
def host_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    hosts = tables.load(spark, sf_dir, "customer").groupBy(F.concat(F.lit("10.0."), k % 16, F.lit("."), k % 200).alias("ip")).agg(F.max(F.when(k % 5 == 0, k + _SINCE).when(k % 5 == 1, 0)).alias("ban_us"))
    return aggregates.host_listing(hosts, tables.host_events(spark, sf_dir), _SINCE, _SINCE + 50)


# ---- quotas, patterns, caches, actions ------------------------------------------------------------------------------


@query(f"""WITH {FILES_SQL}, q AS (SELECT DISTINCT username, substr(username, 5)::BIGINT AS n FROM files)
    SELECT username, CASE WHEN n % 3 * 1000 > 0 AND n % 5 * 400 < n % 3 * 1000 THEN sum(size)::BIGINT // 2 ELSE -1 END AS estimate FROM files JOIN q USING (username) GROUP BY username, n""")
def zip_size_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.files(spark, sf_dir)
    n = F.substring("username", 5, 20).cast("long")
    return checks.zip_estimate(f, "username", f.select("username", (n % 3 * 1000).alias("quota_size"), (n % 5 * 400).alias("used_size")).distinct())


@query("SELECT n_name AS name, count(c_custkey) AS used_files, coalesce(sum(c_custkey), 0)::BIGINT AS used_size FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_nationkey <> 3) ON c_nationkey = n_nationkey GROUP BY 1")
def folder_quota_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    files = tables.load(spark, sf_dir, "customer").where("c_nationkey <> 3").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("name").alias("folder"), F.col("c_custkey").alias("size"))
    return checks.folder_reset(files, n)


@query("SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'FURNITURE' THEN 0 ELSE c_custkey * 10 END AS used_ul, CASE WHEN c_mktsegment = 'FURNITURE' THEN 0 ELSE c_custkey * 7 END AS used_dl FROM customer")
def transfer_quota_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = tables.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment", (F.col("c_custkey") * 10).alias("used_ul"), (F.col("c_custkey") * 7).alias("used_dl"))
    return checks.transfer_reset(users, F.col("c_mktsegment") == "FURNITURE").drop("c_mktsegment")


@query(f"""WITH {FS_SQL} SELECT id, virtual_path AS path, CASE WHEN starts_with(virtual_path, '/click/') THEN ends_with(virtual_path, '.csv') ELSE true END AS allowed
    FROM fs WHERE NOT starts_with(virtual_path, '/error/') OR starts_with(virtual_path, '/error/u1')""")
def file_pattern_deny_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [{"path": "/error", "allowed": ["u1*"], "denied": ["*"], "hide": True}, {"path": "/click", "allowed": ["*.csv"], "denied": ["*.csv", "f1*"]}]
    return policy.visible(tables.fs_events(spark, sf_dir).select("id", F.col("virtual_path").alias("path")), rules)


@query("""WITH p AS (SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN 33 + page_id * 65568 ELSE octet_length(encode(html)) * (page_id % 200) END::BIGINT AS n FROM pages), b AS (SELECT *, n - 33 AS body, (n - 33) % 65568 AS last FROM p)
    SELECT id, CASE WHEN body < 0 THEN 0 WHEN last > 0 AND last <= 32 THEN body ELSE body // 65568 * 65536 + CASE WHEN last > 0 THEN last - 32 ELSE 0 END END::BIGINT AS size FROM b""")
def encrypted_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    files = tables.load(spark, sf_dir, "pages").select(k.alias("id"), F.when(k % 3 == 0, k * 65568 + 33).otherwise(F.octet_length("html") * (k % 200)).cast("long").alias("size"))
    return tables.encrypted_listing(files)


@query("SELECT page_id AS id, replace(url_encode(url || ' a*b~c+é'), '%20', '+') AS escaped FROM pages")
def url_query_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), text.url_query_escaped(F.concat("url", F.lit(" a*b~c+é"))).alias("escaped"))


@query(f"""WITH {FS_SQL} SELECT id, username || ' ' || CASE status WHEN 1 THEN 'OK' ELSE 'KO' END || ' ' || regexp_replace(virtual_path, '/[^/]*$', '') || ' ' || CASE WHEN virtual_target_path <> '' THEN '/archive f' || id ELSE '{{{{.VirtualTargetDirPath}}}} {{{{.TargetName}}}}' END
    || ' ' || replace(virtual_path, '/', '%2F') || ' ' || file_size || ' {{}} {{{{ .Name }}}} ' || strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%g') || ' ' AS body FROM fs""")
def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.fs_events(spark, sf_dir)
    source = "{{.Name}} {{.StatusString}} {{.VirtualDirPath}} {{.VirtualTargetDirPath}} {{.TargetName}} {{.EscapedVirtualPath}} {{.FileSize}} {{.ObjectData}} {{ .Name }} {{.DateTime}} {{.ErrorString}}"
    return e.select("id", text.template(source, text.event_tokens(e.columns)).alias("body"))


@query(f"""WITH {FS_SQL} SELECT id, 'https://hook.example/' || action || '?path=' || replace(virtual_path, '/', '%2F') || '&user=' || username AS request_url, username || ' ' || status AS request_body FROM fs WHERE action = 'delete'""")
def http_action_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.fs_events(spark, sf_dir).where("action = 'delete'")
    return actions.http_requests(e, "https://hook.example/{{.Event}}", body="{{.Name}} {{.Status}}", query={"user": "{{.Name}}", "path": "{{.VirtualPath}}"}).select("id", "request_url", "request_body")


@query(f"WITH {USERS_SQL}, u AS (SELECT username, last_login AS used_at FROM users WHERE last_login >= {AS_OF} - 3600000) SELECT * FROM u ORDER BY used_at DESC, username LIMIT CASE WHEN (SELECT count(*) FROM u) >= 5 THEN 1 ELSE 1000000000 END")
def password_cache_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caches.credentials_kept(tables.users(spark, sf_dir).select("username", F.col("last_login").alias("used_at")), AS_OF, 1)
