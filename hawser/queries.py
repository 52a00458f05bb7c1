"""The queries over the test tables, and the same results as DuckDB SQL.

Adapters (``sources.tables``) present the test tables as file-transfer events, users and files; each query is a thin call
of the library. Times are arguments: AS_OF stands for now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import glob, net, paths, text
from .functions.glob import Pattern
from .operators import aggregates, checks, dml, joins, policy, search
from .plans.rules import FS, PROVIDER, Action, Conditions, Rule, match, plan_actions, run_order
from .sources import tables
from .streaming.state import Defender, RateLimit, defend, limit_rate

AS_OF = 1_706_745_600_000  # 2024-02-01T00:00:00Z
NS_FROM, NS_TO = 1_704_500_000_000_000_000, 1_705_500_000_000_000_000

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _cte(name: str, exprs: dict[str, str], table: str, **fill: str) -> str:
    return f"{name} AS (SELECT {', '.join(f'{v.format(**fill) if fill else v} AS {k}' for k, v in exprs.items())} FROM {table})"


FS_SQL = _cte("fs", tables.FS_EVENTS, "events", us="epoch_us(ts)")
HOST_SQL = _cte("host", tables.HOST_EVENTS, "events", us="epoch_us(ts)")
USERS_SQL = _cte("users", tables.USERS, "customer")
FILES_SQL = _cte("files", tables.FILES, "pages", path=r"regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/+$', '')", bytes="CAST(octet_length(encode(html)) AS BIGINT)")
SCORE_SQL = "CASE event WHEN 'LoginFailed' THEN 1 WHEN 'UserNotFound' THEN 2 WHEN 'NoLoginTried' THEN 0 WHEN 'LimitExceeded' THEN 3 ELSE 0 END"
#: Every directory above a file path, as rows: for path p with d parts, '/' and each prefix of the first d-1 parts.
ANCESTORS_SQL = r"""up AS (SELECT f.*, CASE WHEN n = 0 THEN '/' ELSE '/' || array_to_string(list_slice(parts, 1, n), '/') END AS dir, n
    FROM (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM files) f, LATERAL (SELECT unnest(generate_series(0, len(parts))) AS n))"""

# ---- C2: event search -----------------------------------------------------------------------------------------------

_EVENT_COLUMNS = ["id", "timestamp", "action", "username", "virtual_path", "file_size", "status", "protocol", "ip", "role"]


@query(f"""WITH {FS_SQL} SELECT {', '.join(_EVENT_COLUMNS)} FROM fs WHERE timestamp BETWEEN {NS_FROM} AND {NS_TO}
    AND action IN ('upload', 'download') AND protocol IN ('SFTP', 'DAV') AND status IN (1, 2) AND role = 'role1' ORDER BY timestamp DESC, id DESC LIMIT 100""")
def event_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = search.EventFilter(start=NS_FROM, end=NS_TO, among={"action": search.split_param("upload, download,,upload"), "protocol": ["SFTP", "DAV"], "status": [1, 2]}, role="role2").scoped("role1")
    return search.search_events(tables.fs_events(spark, sf_dir), f).select(*_EVENT_COLUMNS)


@query(f"""WITH {FS_SQL}, edge AS (SELECT timestamp AS t, id AS i FROM fs WHERE timestamp >= {NS_FROM} ORDER BY timestamp, id LIMIT 1 OFFSET 99)
    SELECT {', '.join(_EVENT_COLUMNS)} FROM fs, edge WHERE timestamp > t OR (timestamp = t AND id > i) ORDER BY timestamp, id LIMIT 1000""")
def event_search_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.fs_events(spark, sf_dir)
    last = search.search_events(events, search.EventFilter(start=NS_FROM, order="ASC", limit=100)).agg(F.max(F.struct("timestamp", "id")).alias("m")).first()["m"]
    return search.search_events(events, search.EventFilter(start=last["timestamp"], order="ASC", limit=1000, from_id=str(last["id"]))).select(*_EVENT_COLUMNS)


def _iec_sql(n: str) -> str:
    out = f"concat({n}, ' B')"
    for k, u in ((1, "KiB"), (2, "MiB"), (3, "GiB")):
        d = 1024**k
        low = f"(({n} % {d}) * 10 // {d})"
        over = f"((({n} % {d}) * 10 % {d}) * 2)"
        tenths = f"({n} // {d} * 10 + {low} + CASE WHEN {over} > {d} OR ({over} = {d} AND {low} % 2 = 1) THEN 1 ELSE 0 END)"
        out = f"CASE WHEN {n} >= {d} THEN concat({tenths} // 10, '.', {tenths} % 10, ' {u}') ELSE {out} END"
    return out


_DURATION_SQL = """CASE WHEN e < 1000 THEN concat(e, 'ms') ELSE concat(CASE WHEN e >= 3600000 THEN concat(e // 3600000, 'h') ELSE '' END, CASE WHEN e >= 60000 THEN concat(e // 60000 % 60, 'm') ELSE '' END,
    e // 1000 % 60, CASE WHEN e % 1000 > 0 THEN concat('.', rtrim(lpad((e % 1000)::VARCHAR, 3, '0'), '0')) ELSE '' END, 's') END"""


@query(f"""WITH {FS_SQL}, x AS (SELECT *, elapsed AS e FROM fs)
    SELECT id, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ts_us % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad((ts_us % 1000000)::VARCHAR, 6, '0'), '0') END || 'Z' AS time,
      action, CASE WHEN virtual_target_path <> '' THEN virtual_path || ' => ' || virtual_target_path ELSE virtual_path END AS path,
      CASE WHEN fs_target_path <> '' THEN fs_path || ' => ' || fs_target_path ELSE fs_path END AS fs_path,
      CASE WHEN file_size > 0 THEN {_iec_sql('file_size')} ELSE '' END AS size,
      CASE WHEN elapsed > 0 THEN {_DURATION_SQL} ELSE '' END AS elapsed, CASE status WHEN 1 THEN 'OK' WHEN 2 THEN 'KO' ELSE 'Quota exceeded' END AS status,
      username AS user, protocol, ip, CASE WHEN ssh_cmd <> '' THEN '''=scp' ELSE '' END AS ssh_cmd, role FROM x""")
def event_export_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fs_export(tables.fs_events(spark, sf_dir))


@query(f"WITH {FS_SQL} SELECT id, username, CASE WHEN id % 2 = 0 THEN concat('''', '=', username) ELSE username END AS safe FROM fs")
def csv_injection_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.fs_events(spark, sf_dir)
    cell = F.when(F.col("id") % 2 == 0, F.concat(F.lit("="), "username")).otherwise(F.col("username"))
    return e.select("id", "username", text.csv_safe(cell).alias("safe"))


# ---- C1: relational core --------------------------------------------------------------------------------------------


@query(f"WITH {USERS_SQL} SELECT id, username, status, quota_size, updated_at FROM users WHERE deleted_at = 0")
def soft_delete_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.live(tables.users(spark, sf_dir)).select("id", "username", "status", "quota_size", "updated_at")


@query(f"WITH {USERS_SQL} SELECT * FROM users WHERE username = 'Customer#000000042'")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.users(spark, sf_dir).where(F.col("username") == "Customer#000000042")


@query(f"WITH {USERS_SQL} SELECT id, username, updated_at, deleted_at FROM users WHERE updated_at >= 1706030000000 OR deleted_at > 0")
def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.incremental(tables.users(spark, sf_dir), 1706030000000).select("id", "username", "updated_at", "deleted_at")


@query(f"WITH {USERS_SQL} SELECT id, updated_at FROM users WHERE updated_at > 1706040000000")
def recency_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fresher(tables.users(spark, sf_dir), 1706040000000).select("id", "updated_at")


@query(f"WITH {USERS_SQL} SELECT id, username FROM users")
def minimal_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.users(spark, sf_dir).select("id", "username")


@query(f"WITH {USERS_SQL} SELECT u.id, u.username, n.n_name AS role FROM users u LEFT JOIN nation n ON u.role_id = n.n_nationkey WHERE u.deleted_at = 0 ORDER BY u.username LIMIT 500 OFFSET 20")
def users_page_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = search.page(search.live(tables.users(spark, sf_dir)), "username", limit=900, offset=20)
    nation = tables.load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("role_id"), F.col("n_name").alias("role"))
    return page.join(nation, "role_id", "left").select("id", "username", "role")


@query(f"""WITH {USERS_SQL}, p AS (SELECT id, username FROM users ORDER BY username LIMIT 100)
    SELECT p.id, p.username, coalesce(string_agg(o.o_orderkey::VARCHAR, ',' ORDER BY o.o_orderdate, o.o_orderkey), '') AS children, count(o.o_orderkey) AS n
    FROM p LEFT JOIN orders o ON o.o_custkey = p.id GROUP BY ALL""")
def users_with_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = search.page(tables.users(spark, sf_dir).select("id", "username"), "username")
    shares = tables.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderdate", "o_orderkey")
    nested = joins.with_children(page, shares, "id", ["o_orderdate", "o_orderkey"], "shares", ["o_orderkey"])
    return nested.select("id", "username", F.array_join(F.transform("shares", lambda s: s["o_orderkey"].cast("string")), ",").alias("children"), F.size("shares").cast("long").alias("n"))


@query("""SELECT c_custkey AS id, c_name AS username FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE')))""")
def users_in_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = (tables.load(spark, sf_dir, t) for t in ("region", "nation"))
    wanted = joins.with_match(nation, region.where(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey"))
    return joins.with_match(tables.users(spark, sf_dir), wanted, F.col("nation") == F.col("n_nationkey")).select("id", "username")


@query("SELECT n.n_name AS name, string_agg(DISTINCT c.c_name, ',' ORDER BY c.c_name) AS members FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
def reverse_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = tables.load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    return joins.members(tables.users(spark, sf_dir).join(nation, "nation"), "name", "username").select("name", F.array_join("members", ",").alias("members"))


@query("SELECT o_orderkey AS share, c_name AS owner, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def shares_with_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = tables.users(spark, sf_dir).select(F.col("id").alias("o_custkey"), F.col("username").alias("owner"))
    return tables.load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").join(owner, "o_custkey").select(F.col("o_orderkey").alias("share"), "owner", F.col("o_totalprice").alias("price"))


@query("SELECT s_suppkey AS id, coalesce((SELECT n_nationkey FROM nation WHERE n_name = CASE WHEN s_suppkey % 10 = 0 THEN 'none' ELSE concat('NATION_', s_nationkey) END), -1)::INT AS role_id FROM supplier")
def resolve_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 10 == 0, "none").otherwise(F.concat(F.lit("NATION_"), "s_nationkey")).alias("n_name"))
    return dml.insert_resolved(rows, tables.load(spark, sf_dir, "nation"), "n_name", "n_nationkey", "role_id", -1).select("id", "role_id")


# ---- C4, C5: abuse detection and rate limits ------------------------------------------------------------------------

_SINCE = 1_705_000_000_000_000


@query(f"WITH {HOST_SQL} SELECT ip, sum({SCORE_SQL})::BIGINT AS score FROM host WHERE ts_us >= {_SINCE} GROUP BY ip HAVING sum({SCORE_SQL}) > 0")
def host_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.host_scores(tables.host_events(spark, sf_dir), _SINCE)


@query(f"""WITH {HOST_SQL} SELECT id, ip, sum({SCORE_SQL}) OVER (PARTITION BY ip ORDER BY ts_us RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW)::BIGINT AS score FROM host""")
def host_scores_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.sliding_scores(tables.host_events(spark, sf_dir), 6 * 3_600_000_000).select("id", "ip", "score")


@query(f"WITH {HOST_SQL} SELECT DISTINCT ip FROM host h WHERE NOT EXISTS (SELECT 1 FROM host e WHERE e.ip = h.ip AND e.ts_us >= 1706400000000000)")
def stale_hosts_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.host_events(spark, sf_dir).select("ip", "ts_us")
    return joins.without_match(e.select("ip").distinct(), e.where("ts_us >= 1706400000000000"), "ip")


@query(f"WITH {HOST_SQL} SELECT ip, max(ts_us) AS updated_at FROM host GROUP BY ip ORDER BY 2 DESC LIMIT 20")
def top_recent_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_recent(tables.host_events(spark, sf_dir).groupBy("ip").agg(F.max("ts_us").alias("updated_at")), "updated_at", 20)


@query(f"WITH {HOST_SQL}, h AS (SELECT ip, max(ts_us) AS seen FROM host GROUP BY ip) SELECT ip, seen FROM h ORDER BY seen DESC LIMIT CASE WHEN (SELECT count(*) FROM h) > 60 THEN 50 ELSE 60 END")
def host_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.evict(tables.host_events(spark, sf_dir).groupBy("ip").agg(F.max("ts_us").alias("seen")), "seen", hard=60, soft=50)


@query()
def defender_bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defend(tables.host_events(spark, sf_dir), Defender(threshold=8, observation_min=720, ban_min=240))


@query()
def rate_limit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.host_events(spark, sf_dir).select(F.col("ip").alias("key"), "id", "ts_us")
    return limit_rate(e, RateLimit(average=1, period_ms=3_600_000, burst=2))


# ---- C9: IP lists ---------------------------------------------------------------------------------------------------

_BAD_NETWORKS = [("2001:db8::/32", 2, 0), ("2001:db8:1::/48", 1, 0), ("::1/128", 1, 0), ("nonsense", 2, 0), ("10.0.3.0/99", 2, 0), ("2001:db8::/200", 2, 0)]
_NETWORKS = [("10.0.0.0/8", 1, 0), ("10.0.0.0/16", 2, 0), ("10.0.3.0/24", 1, 1), ("10.0.3.0/25", 2, 2), ("10.0.5.5/32", 1, 0), ("10.0.8.0/21", 2, 12), ("192.168.0.0/16", 2, 0)]
_BIT_SQL = "CASE protocol WHEN 'SSH' THEN 1 WHEN 'FTP' THEN 2 WHEN 'DAV' THEN 4 ELSE 8 END"
_NETS_SQL = "nets(cidr, mode, protocols, net, bits) AS (VALUES " + ", ".join(f"('{c}', {m}, {p}, {sum(int(x) << s for x, s in zip(c.split('/')[0].split('.'), (24, 16, 8, 0)))}, {c.split('/')[1]})" for c, m, p in _NETWORKS) + ")"


@query(f"""WITH {HOST_SQL}, {_NETS_SQL}, a AS (SELECT DISTINCT ip, protocol, string_split(ip, '.')[1]::BIGINT * 16777216 + string_split(ip, '.')[2]::BIGINT * 65536 + string_split(ip, '.')[3]::BIGINT * 256 + string_split(ip, '.')[4]::BIGINT AS n FROM host)
    SELECT a.ip, a.protocol, max_by(mode, bits) AS mode, max_by(cidr, bits) AS cidr FROM a LEFT JOIN nets ON n BETWEEN net AND net + (1::BIGINT << (32 - bits)) - 1 AND (protocols = 0 OR protocols & {_BIT_SQL} <> 0) GROUP BY 1, 2
    UNION ALL SELECT DISTINCT concat('2001:DB8:', right(ip, 1), '::1'), protocol, CASE WHEN right(ip, 1) = '1' THEN 1 ELSE 2 END, CASE WHEN right(ip, 1) = '1' THEN '2001:db8:1::/48' ELSE '2001:db8::/32' END FROM a""")
def ip_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame(_NETWORKS + _BAD_NETWORKS, "cidr string, mode int, protocols int")
    seen = tables.host_events(spark, sf_dir).select("ip", "protocol").distinct()
    six = seen.select(F.concat(F.lit("2001:DB8:"), F.substring("ip", -1, 1), F.lit("::1")).alias("ip"), "protocol").distinct()
    seen = seen.unionByName(six)
    return joins.longest_prefix(seen, entries, protocol="protocol")


@query(f"WITH {HOST_SQL}, d AS (SELECT DISTINCT ip || '/32' AS ipornet FROM host) SELECT ipornet FROM d WHERE ipornet > '10.0.11' AND starts_with(ipornet, '10.0.1') ORDER BY 1 LIMIT 40")
def ip_list_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.host_events(spark, sf_dir).select(F.concat("ip", F.lit("/32")).alias("ipornet")).distinct()
    return search.keyset(d, "ipornet", after="10.0.11", prefix="10.0.1", limit=40)


@query(f"WITH {_NETS_SQL} SELECT cidr, net AS first, net + (1::BIGINT << (32 - bits)) - 1 AS last, CASE WHEN protocols = 0 THEN true ELSE protocols & 2 <> 0 END AS ftp FROM nets")
def network_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.createDataFrame(_NETWORKS, "cidr string, mode int, protocols int")
    return e.select("cidr", net.first_v4(F.col("cidr")).alias("first"), net.last_v4(F.col("cidr")).alias("last"), net.has_protocol(net.protocol_bits(F.col("protocols")), "FTP").alias("ftp"))


@query(f"""WITH {HOST_SQL} SELECT DISTINCT ip, CASE WHEN starts_with(ip, '10.0.3.') THEN true ELSE false END AS allowed FROM host
    UNION ALL SELECT * FROM (VALUES ('2001:db8::1', false), ('2001:db8:9::1', true), ('::ffff:10.0.3.9', true), ('fe80::1', false)) v""")
def login_addr_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    six = spark.createDataFrame([("2001:db8::1",), ("2001:db8:9::1",), ("::ffff:10.0.3.9",), ("fe80::1",)], "ip string")
    seen = tables.host_events(spark, sf_dir).select("ip").distinct().unionByName(six)
    return seen.withColumn("allowed", net.login_allowed(F.col("ip"), a("10.0.3.0/24", "2001:db8:9::/48", "bad"), a("10.0.0.0/21", "2001:db8::/32")))


@query(f"WITH {HOST_SQL} SELECT DISTINCT ip, CASE WHEN starts_with(ip, '10.0.4.') THEN 64 WHEN string_split(ip, '.')[3]::INT BETWEEN 0 AND 7 THEN 128 ELSE 512 END AS kib_per_s FROM host")
def bandwidth_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.array(*[F.struct(F.array(F.lit(c)).alias("sources"), F.lit(v).alias("limit")) for c, v in (("10.0.4.0/24", 64), ("10.0.0.0/21", 128))])
    return tables.host_events(spark, sf_dir).select("ip").distinct().withColumn("kib_per_s", net.bandwidth_for(F.col("ip"), rules, F.lit(512)))


# ---- C6: quota ------------------------------------------------------------------------------------------------------

_TRANSFERS_SQL = """t AS (SELECT l_orderkey AS id, l_linenumber AS line, concat('user', o_custkey % 200) AS username, l_returnflag AS folder,
    CASE WHEN l_linestatus = 'F' THEN 'upload' ELSE 'download' END AS kind,
    CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) * 1000 ELSE 0 END AS ul, CASE WHEN l_linestatus = 'F' THEN 0 ELSE CAST(l_quantity AS BIGINT) * 1000 END AS dl,
    CASE WHEN l_linestatus = 'F' THEN CAST(round(l_discount * 100) AS BIGINT) * 10 ELSE 0 END AS truncated FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    j = li.join(tables.load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    up, n = F.col("l_linestatus") == "F", F.col("l_quantity").cast("long") * 1000
    return j.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.concat(F.lit("user"), F.col("o_custkey") % 200).alias("username"), F.col("l_returnflag").alias("folder"), F.when(up, "upload").otherwise("download").alias("kind"),
        F.when(up, n).otherwise(0).alias("ul"), F.when(up, 0).otherwise(n).alias("dl"), F.when(up, F.round(F.col("l_discount") * 100).cast("long") * 10).otherwise(0).alias("truncated"),
    )


@query(f"WITH {_TRANSFERS_SQL} SELECT username, folder, count(*) AS transfers, sum(ul - truncated)::BIGINT AS growth FROM t WHERE kind = 'upload' GROUP BY 1, 2 HAVING count(*) > 1")
def upload_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.upload_totals(_transfers(spark, sf_dir))


@query(f"WITH {_TRANSFERS_SQL} SELECT username, count(*) AS transfers, sum(ul)::BIGINT AS sum_ul, sum(dl)::BIGINT AS sum_dl FROM t GROUP BY 1 HAVING count(*) > 1")
def transfers_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.user_transfers(_transfers(spark, sf_dir))


@query(f"""WITH {_TRANSFERS_SQL}, u AS (SELECT DISTINCT username, substr(username, 5)::BIGINT AS k FROM t),
    w AS (SELECT t.*, k, count(*) OVER (PARTITION BY username) AS n, sum(ul) OVER (PARTITION BY username) AS su, sum(dl) OVER (PARTITION BY username) AS sd,
      count(*) OVER (PARTITION BY username, folder, kind) AS nf, sum(ul - truncated) OVER (PARTITION BY username, folder, kind) AS g FROM t JOIN u USING (username)),
    r AS (SELECT *, CASE WHEN kind = 'upload' AND nf > 1 AND CASE WHEN folder = 'R' THEN g > 600000 - 10000 ELSE k % 3 > 0 AND g > k % 3 * 700000 - 50000 END AND ul > truncated THEN 'disk'
      WHEN k % 4 > 0 AND su + sd + 300000 > k % 4 * 1048576 AND (ul > 0 OR dl > 0) THEN 'transfer'
      WHEN k % 4 = 0 AND k % 5 > 0 AND sd + 200000 > k % 5 * 1048576 AND dl > 0 THEN 'transfer' END AS reason FROM w WHERE n > 1)
    SELECT id, line, username, folder, kind, ul, dl, truncated, reason FROM r WHERE reason IS NOT NULL""")
def overquota_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _transfers(spark, sf_dir)
    k = F.substring("username", 5, 10).cast("long")
    users = t.select("username").distinct().select(
        "username", (k % 3 * 700000).alias("quota_size"), F.lit(50000).alias("used_size"), (k % 4).alias("limit_total"), F.lit(0).alias("limit_ul"), (k % 5).alias("limit_dl"), F.lit(100000).alias("used_ul"), F.lit(200000).alias("used_dl"),
    )
    folders = spark.createDataFrame([("R", 600_000, 10_000), ("A", -1, 0)], "folder string, quota_size long, used_size long")
    return aggregates.overquota(t, users, folders)


_DELTAS_SQL = "d AS (SELECT concat('user', user_id) AS key, epoch_us(ts) AS ts, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS files, CAST(floor(value * 10) AS BIGINT) * CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS size, event_id % 40 = 0 AS is_reset FROM events)"


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.load(spark, sf_dir, "events")
    sign = "CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END"
    return e.selectExpr("concat('user', user_id) AS key", f"{tables.micros()} AS ts", "event_id AS seq", f"{sign} AS files", f"CAST(floor(value * 10) AS BIGINT) * {sign} AS size", "event_id % 40 = 0 AS is_reset")


@query(f"WITH {_DELTAS_SQL}, x AS (SELECT *, sum(is_reset::INT) OVER (PARTITION BY key ORDER BY ts, seq) AS era FROM d), y AS (SELECT *, max(era) OVER (PARTITION BY key) AS last FROM x) SELECT key, sum(files)::BIGINT AS files, sum(size)::BIGINT AS size FROM y WHERE era = last GROUP BY key")
def quota_fold_delta_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.fold_resets(_deltas(spark, sf_dir))


@query(f"WITH {_DELTAS_SQL} SELECT key, sum(files)::BIGINT AS files, sum(size)::BIGINT AS size FROM d GROUP BY key HAVING sum(files) <> 0 OR sum(size) <> 0")
def quota_deltas_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.coalesce_deltas(_deltas(spark, sf_dir))


@query(f"WITH {FILES_SQL}, u AS (SELECT DISTINCT username FROM files UNION SELECT 'nobody') SELECT u.username, count(path) AS used_files, coalesce(sum(size), 0)::BIGINT AS used_size FROM u LEFT JOIN files USING (username) GROUP BY 1")
def quota_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.files(spark, sf_dir)
    return checks.usage_reset(f, f.select("username").distinct().unionByName(spark.createDataFrame([("nobody",)], "username string")))


@query(f"WITH {FS_SQL} SELECT username, action, min(ts_us) AS first_us FROM fs WHERE action IN ('upload', 'download') GROUP BY 1, 2")
def first_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.first_event(tables.fs_events(spark, sf_dir).where(F.col("action").isin("upload", "download")), ["username", "action"], "ts_us")


# ---- C7, C8, C10: files, retention, policies ------------------------------------------------------------------------


@query(f"WITH {FILES_SQL}, {ANCESTORS_SQL} SELECT username, dir, count(*) AS files, sum(size)::BIGINT AS bytes FROM up WHERE n < len(parts) GROUP BY 1, 2")
def tree_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.tree_usage(tables.files(spark, sf_dir), ["username"])


@query(rf"""WITH {FS_SQL} SELECT id, regexp_replace(virtual_path, '/[^/]*$', '') AS dir, regexp_extract(virtual_path, '([^/]*)$', 1) AS base, regexp_extract(virtual_path, '(\.[^./]*)$', 1) AS ext,
    regexp_extract(virtual_path, '([^/.]*)\.[^./]*$', 1) AS stem, virtual_path AS clean, array_to_string([virtual_path, regexp_replace(virtual_path, '/[^/]*$', ''), regexp_replace(virtual_path, '/[^/]*/[^/]*$', ''), '/'], ' ') AS up FROM fs""")
def path_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("virtual_path")
    messy = F.concat(F.replace(p, F.lit("/u"), F.lit("\\x/..//./u")))
    return tables.fs_events(spark, sf_dir).select("id", paths.parent(p).alias("dir"), paths.base(p).alias("base"), paths.extension(p).alias("ext"), paths.stem(p).alias("stem"), paths.clean(messy).alias("clean"), F.array_join(paths.ancestors(p), " ").alias("up"))


_POLICIES = [("/", 20000), ("/fr", 10000), ("/en", 500), ("/de", 0), ("/en/1", 24)]
_POLICY_SQL = "pol(policy_path, hours) AS (VALUES " + ", ".join(f"('{p}', {h})" for p, h in _POLICIES) + ")"
_NEAR_SQL = f"near AS (SELECT path, username, size, mtime_ms, max_by(policy_path, n) AS policy_path, max_by(hours, n) AS hours FROM up JOIN pol ON dir = policy_path GROUP BY ALL)"


def _policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_POLICIES, "policy_path string, hours int")


@query(f"WITH {FILES_SQL}, {ANCESTORS_SQL}, {_POLICY_SQL}, one AS (SELECT path, dir, n FROM up GROUP BY ALL) SELECT path, max_by(policy_path, n) AS policy_path, max_by(hours, n) AS hours FROM one JOIN pol ON dir = policy_path GROUP BY path")
def nearest_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.nearest_policy(tables.files(spark, sf_dir).select("path").distinct(), _policies(spark))


@query(f"WITH {FS_SQL} SELECT id, CASE WHEN virtual_path LIKE '/purchase/u1/%' THEN 'list' WHEN starts_with(virtual_path, '/purchase/') THEN 'list,upload' WHEN starts_with(virtual_path, '/error/') THEN '' ELSE '*' END AS permissions FROM fs")
def permission_for_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    perms = spark.createDataFrame([("/", ["*"]), ("/purchase", ["list", "upload"]), ("/purchase/u1", ["list"]), ("/error", [])], "policy_path string, permissions array<string>")
    rows = tables.fs_events(spark, sf_dir).select("id", F.col("virtual_path").alias("path"))
    return joins.permissions_for(rows, perms).select("id", F.array_join("permissions", ",").alias("permissions"))


_RETAIN_SQL = f"WITH {FILES_SQL}, {ANCESTORS_SQL}, {_POLICY_SQL}, {_NEAR_SQL}, del AS (SELECT * FROM near WHERE hours > 0 AND mtime_ms + hours * 3600000::BIGINT < {AS_OF})"


@query(f"{_RETAIN_SQL} SELECT path, username, size, policy_path, hours FROM del")
def retention_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.retention(tables.files(spark, sf_dir), _policies(spark), AS_OF).select("path", "username", "size", "policy_path", "hours")


@query(f"{_RETAIN_SQL} SELECT policy_path, pol.hours, count(path) AS deleted_files, coalesce(sum(size), 0)::BIGINT AS deleted_size FROM pol LEFT JOIN del USING (policy_path) WHERE pol.hours > 0 GROUP BY 1, 2")
def retention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _policies(spark)
    return checks.retention_report(checks.retention(tables.files(spark, sf_dir), p, AS_OF), p)


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE regexp_matches(p_name, '^[^/]*l[^/]e[^/]*t$')")
def name_search_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "part").where(glob.search_name(F.col("p_name"), "*l?e*t")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'e wid')")
def name_search_substr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "part").where(glob.search_name(F.col("p_name"), "E Wid")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query(f"WITH {FILES_SQL}, h AS (SELECT DISTINCT path FROM files WHERE contains(path, '7')), o AS (SELECT path, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS d FROM h) SELECT path FROM o ORDER BY d, path LIMIT 2000")
def recursive_file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_files(tables.files(spark, sf_dir).select("path").distinct(), glob.search_name(paths.base(F.col("path")), "7"))


@query(f"WITH {FILES_SQL} SELECT username, sum(size)::BIGINT // 2 AS estimate FROM files GROUP BY 1")
def zip_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.zip_estimate(tables.files(spark, sf_dir), "username")


# ---- C3: rules ------------------------------------------------------------------------------------------------------

_RULES = [
    Rule("big-uploads", FS, Conditions(events=["upload"], min_size=2_000_000, statuses=[1]), [Action("notify", 1), Action("scan", 2, execute_sync=True, stop_on_failure=True), Action("alert", 3, is_failure_action=True, stop_on_failure=True), Action("page", 4, is_failure_action=True)]),
    Rule("text-only", FS, Conditions(events=["upload", "download", "delete"], paths=[Pattern("/**/*.txt")], protocols=["SFTP", "HTTP"]), [Action("archive", 1)]),
    Rule("not-user1", FS, Conditions(events=["mkdir"], names=[Pattern("user1*", inverse=True)], roles=[Pattern("role?")]), [Action("audit", 1)]),
    Rule("off", FS, Conditions(events=["mkdir"]), [], status=0),
]
_MATCH_SQL = f"""{FS_SQL}, m AS (
    SELECT id, 'big-uploads' AS rule, status FROM fs WHERE action = 'upload' AND file_size >= 2000000
    UNION ALL SELECT id, 'text-only', status FROM fs WHERE action IN ('upload', 'download', 'delete') AND regexp_matches(virtual_path, '\\.txt$') AND protocol IN ('SFTP', 'HTTP')
    UNION ALL SELECT id, 'not-user1', status FROM fs WHERE action = 'mkdir' AND NOT starts_with(username, 'user1') AND regexp_matches(role, '^role.$'))"""


@query(f"WITH {_MATCH_SQL} SELECT id, rule FROM m")
def rule_match_fs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(tables.fs_events(spark, sf_dir), _RULES).select("id", "rule")


@query(f"WITH {_MATCH_SQL} SELECT id, rule, action_name, position FROM m JOIN (VALUES ('big-uploads', 'notify', 1), ('big-uploads', 'scan', 2), ('big-uploads', 'alert', 3), ('big-uploads', 'page', 4), ('text-only', 'archive', 1), ('not-user1', 'audit', 1)) a(r, action_name, position) ON rule = r WHERE rule <> 'big-uploads' OR status = 1")
def rule_action_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_actions(match(tables.fs_events(spark, sf_dir), _RULES), _RULES).select("id", "rule", "action_name", "position")


@query(f"WITH {_MATCH_SQL} SELECT id, rule, CASE WHEN rule = 'big-uploads' THEN CASE WHEN id % 2 <> 0 AND id % 3 <> 0 THEN 'scan,notify' WHEN id % 7 = 0 THEN 'scan,notify,alert' ELSE 'scan,notify,alert,page' END WHEN rule = 'text-only' THEN 'archive' ELSE 'audit' END AS ran, CASE WHEN rule = 'big-uploads' AND (id % 2 = 0 OR id % 3 = 0) THEN 2 ELSE 1 END AS status FROM m WHERE rule <> 'big-uploads' OR status = 1")
def rule_action_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_actions(match(tables.fs_events(spark, sf_dir), _RULES), _RULES)
    ok = F.when(F.col("action_name") == "scan", F.col("id") % 2 != 0).when(F.col("action_name") == "notify", F.col("id") % 3 != 0).when(F.col("action_name") == "alert", F.col("id") % 7 != 0).otherwise(True)
    return run_order(plan.withColumn("ok", ok), ["id", "rule"]).select("id", "rule", F.array_join("ran", ",").alias("ran"), "status")


@query("SELECT o_orderkey AS id, 'orders-changed' AS rule FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_custkey % 100 <> 1 AND o_custkey % 3 = 1")
def rule_match_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "add").when(F.col("o_orderstatus") == "F", "update").otherwise("delete").alias("action"),
        F.concat(F.lit("user"), F.col("o_custkey") % 100).alias("username"), F.concat(F.lit("role"), F.col("o_custkey") % 3).alias("role"), F.lit("share").alias("object_type"),
    )
    rule = Rule("orders-changed", PROVIDER, Conditions(events=["add", "update"], names=[Pattern("user1", inverse=True)], roles=[Pattern("role1")], objects=["share", "user"]))
    return match(o, [rule]).select("id", "rule")




@query(f"WITH {FS_SQL} SELECT id, CASE WHEN regexp_matches(virtual_path, '\\.csv$') THEN true WHEN starts_with(virtual_path, '/error/') THEN false ELSE true END AS hit FROM fs")
def pattern_list_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = [Pattern("/**/*.csv"), Pattern("/error/**", inverse=True), Pattern("/**/u1?/*")]
    return tables.fs_events(spark, sf_dir).select("id", glob.matches_list(F.col("virtual_path"), ps).alias("hit"))


@query("SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN true WHEN c_custkey % 2 = 0 THEN true ELSE false END AS hit FROM customer")
def group_pattern_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.array("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "even-x").otherwise("odd-x"))
    return tables.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), glob.matches_groups(groups, [Pattern("BUILD*"), Pattern("even-?")]).alias("hit"))


@query(f"WITH {FS_SQL}, x AS (SELECT id, make_timestamp(ts_us) AS t FROM fs) SELECT id, (dayofweek(t) = 0 OR (dayofweek(t) = 1 AND strftime(t, '%H:%M') BETWEEN '09:00' AND '17:30') OR (dayofweek(t) = 5 AND strftime(t, '%H:%M') BETWEEN '20:15' AND '23:59')) AS allowed FROM x")
def access_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.array(*[F.struct(F.lit(d).alias("day"), F.lit(a).alias("from"), F.lit(z).alias("to")) for d, a, z in ((0, "00:00", "23:59"), (1, "09:00", "17:30"), (5, "20:15", "23:59"))])
    return tables.fs_events(spark, sf_dir).select("id", policy.in_access_window(F.timestamp_micros("ts_us"), w).alias("allowed"))


# ---- scheduled checks and policy merge ------------------------------------------------------------------------------


@query(f"WITH {USERS_SQL} SELECT id, username, expiration_date FROM users WHERE expiration_date > 0 AND expiration_date < {AS_OF}")
def expired_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.expired(tables.users(spark, sf_dir), AS_OF).select("id", "username", "expiration_date")


@query(f"WITH {USERS_SQL} SELECT id FROM users WHERE status >= 1 AND (expiration_date = 0 OR expiration_date >= {AS_OF})")
def usable_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.users(spark, sf_dir).where(policy.account_usable(F.lit(AS_OF))).select("id")


@query(f"""WITH {USERS_SQL}, d AS (SELECT id, status, CAST(trunc(({AS_OF} - CASE WHEN last_login > 0 THEN last_login ELSE created_at END) / 86400000.0) AS INT) AS days FROM users),
    a AS (SELECT id, days, CASE WHEN days > 15 AND status = 0 THEN 'delete' WHEN days > 10 AND status > 0 THEN 'disable' END AS action FROM d) SELECT * FROM a WHERE action IS NOT NULL""")
def inactive_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.inactive(tables.users(spark, sf_dir), AS_OF, disable_after=10, delete_after=15).select("id", "days", "action")


@query(f"""WITH {USERS_SQL}, x AS (SELECT id, last_password_change + (id % 3 * 15)::BIGINT * 86400000 - {AS_OF} AS due FROM users WHERE id % 3 > 0 AND (expiration_date = 0 OR expiration_date >= {AS_OF})),
    y AS (SELECT id, CASE WHEN CAST(round(due / 86400000.0) AS INT) = 0 AND due > 0 THEN 1 ELSE CAST(round(due / 86400000.0) AS INT) END AS days FROM x) SELECT id, days FROM y WHERE days <= 5""")
def password_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = tables.users(spark, sf_dir).withColumn("password_expiration", F.col("id") % 3 * 15)
    return checks.password_notices(u, AS_OF, 5).select("id", "days")


@query(f"""WITH {USERS_SQL}, g AS (SELECT r_name AS name, r_regionkey, (r_regionkey + 1) * 1000 AS qf, r_regionkey * 10 AS ul FROM region)
    SELECT id, username, CASE WHEN quota_files <> 0 THEN quota_files ELSE coalesce(qf, 0) END AS quota_files, quota_size,
      CASE WHEN upload_data_transfer = 0 AND total_data_transfer = 0 THEN coalesce(ul, 0) ELSE upload_data_transfer END AS upload_data_transfer,
      CASE WHEN upload_data_transfer = 0 AND total_data_transfer = 0 THEN coalesce(r_regionkey * 5, 0) ELSE total_data_transfer END AS total_data_transfer,
      CASE WHEN expiration_date <> 0 THEN expiration_date WHEN r_regionkey > 0 THEN created_at + r_regionkey * 30 * 86400000::BIGINT ELSE 0 END AS expiration_date
    FROM users JOIN nation ON nation = n_nationkey LEFT JOIN g ON r_regionkey = n_regionkey""")
def group_settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = tables.load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").cast("string").alias("group_name"))
    k = F.col("r_regionkey")
    groups = tables.load(spark, sf_dir, "region").select(k.cast("string").alias("name"), ((k + 1) * 1000).alias("quota_files"), (k * 10).alias("upload_data_transfer"), (k * 5).alias("total_data_transfer"), (k * 30).alias("expires_in"))
    u = tables.users(spark, sf_dir).drop("group_name").join(nation, "nation")
    return policy.merge_primary(u, groups).select("id", "username", "quota_files", "quota_size", "upload_data_transfer", "total_data_transfer", "expiration_date")


# ---- C11, functions, DML --------------------------------------------------------------------------------------------


@query(f"""WITH {FS_SQL} SELECT protocol, count_if(action = 'upload' AND status = 1) AS uploads_total, count_if(action = 'upload' AND status <> 1) AS upload_errors_total, coalesce(sum(file_size) FILTER (action = 'upload'), 0)::BIGINT AS upload_size,
    count_if(action = 'download' AND status = 1) AS downloads_total, count_if(action = 'download' AND status <> 1) AS download_errors_total, coalesce(sum(file_size) FILTER (action = 'download'), 0)::BIGINT AS download_size,
    count_if(action NOT IN ('upload', 'download') AND status = 1) AS commands_total, count_if(action NOT IN ('upload', 'download') AND status <> 1) AS command_errors_total FROM fs GROUP BY 1""")
def transfer_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.transfer_counters(tables.fs_events(spark, sf_dir))


@query(f"""WITH {FS_SQL} SELECT CASE fs_provider WHEN 1 THEN 's3' WHEN 2 THEN 'gcs' ELSE 'az' END AS store, """
       + ", ".join(f"count_if(action = '{a}' AND status = 1) AS {a}_total, count_if(action = '{a}' AND status <> 1) AS {a}_errors" for a in ("upload", "download", "delete", "copy", "list", "head"))
       + ", coalesce(sum(file_size) FILTER (action = 'upload'), 0)::BIGINT AS upload_size, coalesce(sum(file_size) FILTER (action = 'download'), 0)::BIGINT AS download_size FROM fs WHERE fs_provider IN (1, 2, 3) GROUP BY 1")
def store_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.store_counters(tables.fs_events(spark, sf_dir))


_METHOD_SQL = "CASE event_id % 9 WHEN 0 THEN 'public_key' WHEN 1 THEN 'keyboard_interactive' WHEN 2 THEN 'key_and_password' WHEN 3 THEN 'key_and_keyboard_int' WHEN 4 THEN 'tls_cert' WHEN 5 THEN 'tls_cert_and_pwd' WHEN 6 THEN 'idp' ELSE 'password' END"


@query(f"SELECT {_METHOD_SQL} AS method, count(*) AS attempts, count_if(event_type <> 'error') AS login_ok, count_if(event_type = 'error') AS login_ko FROM events GROUP BY 1")
def login_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(m) for m in [*aggregates.LOGIN_METHODS, "password", "other"]])
    order = ["publickey", "keyboard-interactive", "publickey+password", "publickey+keyboard-interactive", "TLSCertificate", "TLSCertificate+password", "IDP", "password", "other"]
    names = F.array(*[F.lit(m) for m in order])
    e = tables.load(spark, sf_dir, "events").select(F.get(names, (F.col("event_id") % 9).cast("int")).alias("method"), (F.col("event_type") != "error").alias("ok"))
    return aggregates.login_counters(e)


@query("SELECT CASE WHEN s BETWEEN 200 AND 299 THEN 'ok' WHEN s BETWEEN 400 AND 499 THEN 'client_error' WHEN s >= 500 THEN 'server_error' ELSE 'other' END AS class, count(*) AS requests FROM (SELECT 200 + event_id % 5 * 100 + event_id % 3 AS s FROM events) GROUP BY 1")
def http_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.http_counters(tables.load(spark, sf_dir, "events").select((200 + F.col("event_id") % 5 * 100 + F.col("event_id") % 3).alias("status")))


@query(f"WITH {HOST_SQL} SELECT ip, count(*) AS connections FROM host GROUP BY 1")
def connections_per_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.per_client(tables.host_events(spark, sf_dir))


@query("SELECT p_partkey AS id, md5(p_name) AS md5, sha1(p_name) AS sha1, sha256(p_name) AS sha256, lower(hex(p_name)) AS hex_id FROM part")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("p_name")
    h = text.hashes(c.cast("binary"))
    return tables.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), h["md5"].alias("md5"), h["sha1"].alias("sha1"), h["sha256"].alias("sha256"), text.hex_id(c).alias("hex_id"))


@query(f"SELECT o_orderkey AS id, {_iec_sql('CAST(floor(o_totalprice * o_totalprice) AS BIGINT)')} AS size FROM orders")
def humanize_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.size_iec(F.floor(F.col("o_totalprice") * F.col("o_totalprice"))).alias("size"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_size * 1000 WHEN 1 THEN p_size * 1048576 WHEN 2 THEN p_size ELSE NULL END::BIGINT AS bytes FROM part")
def parse_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.get(F.array(*[F.lit(u) for u in (" kB", "MiB", "", " parsecs")]), (F.col("p_partkey") % 4).cast("int"))
    return tables.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.parse_size(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


@query(f"WITH {FS_SQL} SELECT id, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%g') AS millis, 'file ' || username || ' {{{{.Nope}}}} at ' || strftime(make_timestamp(ts_us), '%Y/%m') AS body FROM fs")
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.floor(F.col("ts_us") / 1000).cast("long")
    body = text.template("file {{.Name}} {{.Nope}} at {{.Year}}/{{.Month}}", {"Name": F.col("username"), **text.date_parts(ms)})
    return tables.fs_events(spark, sf_dir).select("id", text.millis_text(ms).alias("millis"), body.alias("body"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN greatest(100 - p_size, 0) WHEN 1 THEN p_size WHEN 2 THEN p_size ELSE NULL END::BIGINT AS start,
    CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN 100 - p_size WHEN 2 THEN least(p_size + 60, 99) - p_size + 1 ELSE NULL END::BIGINT AS length FROM part""")
def byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    head = F.concat(F.lit("bytes="), F.when(k == 0, F.concat(F.lit("-"), s)).when(k == 1, F.concat(s, F.lit("-"))).when(k == 2, F.concat(s, F.lit("-"), (F.col("p_size") + 60).cast("string"))).otherwise(F.lit("-0")))
    start, length = text.byte_range(head, F.lit(100))
    return tables.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), start.alias("start"), length.alias("length"))


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.from_json("props", "k int")["k"].alias("k"))


_OLD_NEW = "o AS (SELECT user_id AS id, event_type AS name, epoch_us(ts) AS updated_at FROM events WHERE event_id % 2 = 0), n AS (SELECT user_id AS id, event_type AS name, epoch_us(ts) AS updated_at FROM events WHERE event_id % 2 = 1)"


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = tables.load(spark, sf_dir, "events")
    cols = ["user_id AS id", "event_type AS name", f"{tables.micros()} AS updated_at"]
    return e.where("event_id % 2 = 0").selectExpr(*cols), e.where("event_id % 2 = 1").selectExpr(*cols)


@query(f"WITH {_OLD_NEW} SELECT id, arg_max(name, updated_at) AS name, max(updated_at) AS updated_at FROM (SELECT * FROM o UNION ALL SELECT * FROM n) GROUP BY id")
def latest_wins_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.upsert(*_old_new(spark, sf_dir), ["id"], "updated_at")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def restore_add_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = tables.load(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name")
    return dml.restore(current, tables.users(spark, sf_dir).selectExpr("id", "username AS name"), ["id"], 1)[0]


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def restore_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = tables.load(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name")
    return dml.restore(current, tables.users(spark, sf_dir).selectExpr("id", "username AS name"), ["id"], 0)[0]


@query(f"WITH {USERS_SQL} SELECT id, deleted_at FROM users WHERE deleted_at = 0 OR deleted_at >= 1706500000700")
def purge_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.purge(tables.users(spark, sf_dir), 1706500000700 + 1_800_000).select("id", "deleted_at")


@query("SELECT conv_id AS parent, text AS item, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text NULLS FIRST) - 1 AS sort_order FROM conversations")
def replace_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.load(spark, sf_dir, "conversations")
    lists = c.groupBy(F.col("conv_id").alias("parent")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("items"))
    none = lists.select("parent", F.lit("").alias("item"), F.lit(0).alias("sort_order"))
    return dml.replace_links(none, lists, "parent", "items", "item").select("parent", "item", F.col("sort_order").cast("long").alias("sort_order"))


@query()
def share_token_reservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.load(spark, sf_dir, "events").selectExpr("concat('s', user_id) AS share", f"{tables.micros()} AS seq", "event_id % 4 + 1 AS n", "0L AS used", "CASE WHEN user_id % 10 = 0 THEN 0 ELSE 60 END AS max_tokens")
    return dml.reserve_tokens(e)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
