"""Operators against expected values and against folds written out."""

import pytest
from pyspark.sql import functions as F

from hawser.functions.glob import Pattern
from hawser.operators import aggregates, checks, dml, joins, policy, search
from hawser.plans.rules import FS, PROVIDER, Conditions, Rule, match
from hawser.sources import tables
from hawser.streaming.state import Defender, RateLimit, defend, limit_rate

MB = 1048576


def test_nearest_folder(spark):
    pol = spark.createDataFrame([("/dir2", 168), ("/dir3", 168), ("/dir2/sub1/sub", 24)], "policy_path string, hours int")
    want = {"/": None, "/dir3": "/dir3", "/dir2/sub3": "/dir2", "/dir2/sub2": "/dir2", "/dir2/sub1": "/dir2", "/dir2/sub1/sub/sub": "/dir2/sub1/sub"}
    rows = spark.createDataFrame([(p,) for p in want], "path string")
    got = {r["path"]: r["policy_path"] for r in joins.nearest_policy(rows, pol).collect()}
    assert got == want


TRANSFER = [
    ((1, 0, 0), (524288, 1048576), (0, 0), (100, 100), False),
    ((1, 0, 0), (524288, 1048576), (1, 0), (100, 100), True),
    ((1, 0, 0), (524188, 524188), (1, 0), (100, 100), False),
    ((1, 0, 0), (524188, 524188), (1, 0), (101, 100), True),
    ((0, 0, 1), (0, 524288), (0, 100), (0, 524288), False),
    ((0, 0, 1), (0, 524288), (0, 100), (0, 524289), True),
    ((0, 1, 0), (524288, 0), (0, 0), (524289, 0), False),
    ((0, 1, 0), (524288, 0), (1, 0), (524289, 0), True),
]


@pytest.mark.parametrize("limit,used,cur,sums,want", TRANSFER)
def test_transfer_exceeded(spark, limit, used, cur, sums, want):
    d = lambda names, v: dict(zip(names, map(F.lit, v), strict=True))
    c = aggregates.transfer_exceeded(d(("total", "ul", "dl"), limit), d(("ul", "dl"), used), d(("ul", "dl"), cur), d(("ul", "dl"), sums))
    assert spark.range(1).select(c.alias("v")).first()["v"] is want


def test_provider_rule(spark):
    rule = Rule("r", PROVIDER, Conditions(events=["add", "update"], names=[Pattern("user1", True)], roles=[Pattern("role1")]))
    e = spark.createDataFrame([("user1", "add", "role1"), ("user2", "update", "role1"), ("user2", "delete", "role1"), ("user2", "add", "role2")], "username string, action string, role string")
    assert [(r["username"], r["action"]) for r in match(e, [rule]).collect()] == [("user2", "update")]


def test_rule_sizes_and_loop_guard(spark):
    rule = Rule("r", FS, Conditions(events=["upload", "mkdir"], min_size=10))
    e = spark.createDataFrame([("u", "upload", "SFTP", 5), ("u", "upload", "SFTP", 10), ("u", "mkdir", "SFTP", 0), ("u", "upload", "EventAction", 99)], "username string, action string, protocol string, file_size long")
    assert sorted((r["action"], r["file_size"]) for r in match(e, [rule]).collect()) == [("mkdir", 0), ("upload", 10)]


def test_inactivity(spark):
    now = 1_700_000_000_000
    day = 86_400_000
    rows = [(0, 0, 0), (now - 10 * day - 5000, 0, 10), (0, now + 10 * day - 5000, -9)]
    df = spark.createDataFrame(rows, "last_login long, created_at long, want int")
    assert all(r["d"] == r["want"] for r in df.withColumn("d", checks.inactivity_days(now)).collect())


def test_rate_limiter():
    r = RateLimit(average=1, period_ms=1000, burst=1)
    state, ok, _ = r.step((1.0, 0), 0)
    assert ok
    _, ok, delay = r.step(state, 1)
    assert not ok and delay > r.max_delay_us
    assert r.step(state, 1_000_000)[1]
    assert not RateLimit(1, 1000, 0).step((0.0, 0), 0)[1]


def test_rate_limiter_keys(spark):
    e = spark.createDataFrame([("a", 1, 0), ("a", 2, 10), ("b", 3, 20)], "key string, id long, ts_us long")
    assert {r["id"]: r["passed"] for r in limit_rate(e, RateLimit(1)).collect()} == {1: True, 2: False, 3: True}


def test_defender(spark):
    m = 60_000_000
    e = spark.createDataFrame([("h", 1, 0, "LoginFailed"), ("h", 2, m, "UserNotFound"), ("h", 3, 2 * m, "UserNotFound"), ("h", 4, 3 * m, "LoginFailed"), ("h", 5, 40 * m, "LoginFailed"), ("g", 6, 0, "LimitExceeded")], "ip string, id long, ts_us long, event string")
    got = {r["id"]: r for r in defend(e, Defender(threshold=5, observation_min=15, ban_min=10, ban_increment=2)).collect()}
    assert [got[i]["total"] for i in (1, 2, 3)] == [1, 3, 5]
    assert not got[2]["banned"] and got[3]["banned"] and got[3]["banned_until_us"] == 12 * m
    assert got[4]["banned_until_us"] == 12 * m  # an event during a ban is ignored
    assert got[5]["total"] == 1 and not got[6]["banned"]
    stored = Defender(threshold=5, observation_min=15, ban_min=10, stored=True)
    s = stored.step({"events": [(0, 3)], "until": 0}, 15 * m, 2)
    assert s["total"] == 5 and not s["banned"]  # the edge counts, and only more than the threshold bans


def test_defender_checks_and_events_without_score():
    m, d = 60_000_000, Defender(threshold=3, observation_min=15, ban_min=10, ban_increment=2)
    known = d.step({}, 0, 0)
    assert known["events"] == [(0, 0)] and d.step(known, 1, 3)["banned"]  # known by an event without a score
    assert not d.step({}, 0, 3)["banned"]
    banned = {"events": [], "until": 10 * m}
    assert d.check(banned, m)["until"] == 11 * m and d.check(banned, 10 * m)["until"] == 10 * m


def test_stored_defender(spark):
    s = Defender(threshold=5, stored=True).step({}, 0, 0)
    assert s["events"] == [] and not s["banned"]


def test_rules_of_provider_groups_idp_and_paths(spark):
    from hawser.plans.rules import IDP_LOGIN

    fs = Rule("r", FS, Conditions(events=["rename"], paths=[Pattern("/**/*.txt")]))
    e = spark.createDataFrame([("u", "rename", "SFTP", "/a/x.bin", "/b/x.txt"), ("u", "rename", "SFTP", "/a/y.txt", "/b/y.bin")], "username string, action string, protocol string, virtual_path string, virtual_target_path string")
    assert [r["virtual_path"] for r in match(e, [fs]).collect()] == ["/a/y.txt"]
    p = Rule("r", PROVIDER, Conditions(events=["add"], groups=[Pattern("group1")]))
    e = spark.createDataFrame([("a", "add", ["g9"]), ("b", "add", ["group1"])], "username string, action string, groups array<string>")
    assert [r["username"] for r in match(e, [p]).collect()] == ["b"]
    i = Rule("r", IDP_LOGIN, Conditions(names=[Pattern("a*")], roles=[Pattern("none")], idp_event=1))
    e = spark.createDataFrame([("ab", 1, "x"), ("ab", 2, "x"), ("b", 1, "x")], "username string, idp_event int, role string")
    assert [(r["username"], r["idp_event"]) for r in match(e, [i]).collect()] == [("ab", 1)]
    assert match(spark.createDataFrame([("u", "upload")], "username string, action string"), [Rule("r", FS, Conditions(events=["upload"], roles=[Pattern("r")]))]).count() == 0


def test_admission(spark):
    r = spark.createDataFrame([("10.0.0.1",), ("10.0.0.2",), ("10.0.0.3",)], "ip string")
    c = spark.createDataFrame([("10.0.0.1", 5), ("10.0.0.2", 6)], "ip string, connections long")
    ok = lambda **k: sorted(x["ip"][-1] for x in aggregates.admitted(r, c, **k).where("allowed").collect())
    assert ok(max_total=0, max_per_host=5) == ["1", "3"] and ok(max_total=0, max_per_host=5, safe=F.lit(True)) == ["1", "2", "3"]
    assert ok(max_total=0, max_per_host=0, listed=F.col("ip") == "10.0.0.2") == ["2"] and ok(max_total=9, max_per_host=0, connections=9, transfers=8, sessions=8) == ["1", "2", "3"]
    assert ok(max_total=9, max_per_host=0, connections=10) == ok(max_total=9, max_per_host=0, transfers=9) == ok(max_total=9, max_per_host=0, sessions=9) == []


def test_over_quota_of_folders_and_growth(spark):
    t = spark.createDataFrame([("u", "/vdir", "upload", 90, 0, 0, 1), ("u", "/vdir", "upload", 20, 0, 20, 2), ("u", "/vdir", "upload", 20, 0, 0, 3)], "username string, folder string, kind string, ul long, dl long, truncated long, id int")
    u = spark.sql("SELECT 'u' AS username, 120L AS quota_size, 0L AS used_size, 0 AS limit_total, 0 AS limit_ul, 0 AS limit_dl, 0L AS used_ul, 0L AS used_dl")
    f = spark.createDataFrame([("/vdir", 100, 0)], "folder string, quota_size long, used_size long")
    assert aggregates.overquota(t, u).count() == 0
    assert sorted(r["id"] for r in aggregates.overquota(t, u, f).collect()) == [1, 3]  # the second has not grown


def test_transfer_space(spark):
    v = lambda *a: spark.range(1).select(policy.has_upload_space(*map(F.lit, a)).alias("v")).first()["v"]
    assert v(0, 9, 0, 9) and v(10, 9, 0, 99) and not v(10, 10, 0, 0) and v(5, 9, 10, 9) and not v(99, 0, 10, 10)


def test_policies_of_repeated_rows(spark):
    pol = spark.createDataFrame([("/a", 1)], "policy_path string, hours int")
    rows = spark.createDataFrame([("/a/b", 1), ("/a/b", 1), (None, 2), ("/c", 3)], "path string, n int").repartition(3)
    assert sorted((r["n"], r["hours"] or 0) for r in joins.nearest_policy(rows, pol).collect()) == [(1, 1), (1, 1), (2, 0), (3, 0)]


def test_over_quota_gate(spark):
    t = spark.createDataFrame([("a", "f", "upload", 100, 0, 0), ("b", "f", "upload", 100, 0, 0), ("b", "f", "upload", 100, 0, 0)], "username string, folder string, kind string, ul long, dl long, truncated long")
    u = spark.createDataFrame([("a", 50), ("b", 150)], "username string, quota_size long").selectExpr("*", "0 AS used_size", "0 AS limit_total", "0 AS limit_ul", "0 AS limit_dl", "0 AS used_ul", "0 AS used_dl")
    assert [r["username"] for r in aggregates.overquota(t, u).collect()] == ["b", "b"]


def test_restore_modes(spark):
    cur, new = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), spark.createDataFrame([(2, "B"), (3, "C")], "id long, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(dml.restore(cur, new, ["id"], 1)[0]) == [(1, "a"), (2, "b"), (3, "C")]
    table, ended = dml.restore(cur, new, ["id"], 2)
    assert rows(table) == [(1, "a"), (2, "B"), (3, "C")] and rows(ended) == [(2,)]
    assert dml.restore(cur, new, ["id"], 0)[1].count() == 0


def test_token_reservation(spark):
    r = spark.createDataFrame([("s", 1, 3, 0, 5), ("s", 2, 3, 0, 5), ("s", 3, 2, 0, 5)], "share string, seq long, n long, used long, max_tokens long")
    assert [x["granted"] for x in sorted(dml.reserve_tokens(r).collect(), key=lambda x: x["seq"])] == [True, False, True]


def test_policy_merge(spark):
    m = lambda **k: F.create_map(*[F.lit(x) for kv in k.items() for x in (kv[0].replace("root", "/"), kv[1])])
    v = spark.range(1).select(policy.merge_maps(m(root="u", a="u"), m(root="g", a="g", b="g"), primary=True).alias("p"), policy.merge_maps(m(root="u", a="u"), m(root="g", b="g")).alias("s")).first()
    assert v["p"] == {"/": "g", "a": "u", "b": "g"} and v["s"] == {"/": "u", "a": "u", "b": "g"}


def test_event_filter_limits(spark):
    with pytest.raises(ValueError):
        search.search_events(spark.range(1), search.EventFilter(limit=1001))
    assert search.split_param(" a, ,b,a") == ["a", "b"]
    assert search.int_params("1,x,2", {1, 2}, strict=False) == [1, 2]
    with pytest.raises(ValueError):
        search.int_params("1,x", {1, 2}, strict=True)


def test_store_listing(spark):
    keys = spark.createDataFrame([("a/b/1", 3), ("a/b/2", 4), ("a/c", 5), ("x", 1)], "key string, size long")
    assert sorted(map(tuple, tables.store_listing(keys, "a/").collect())) == [("b", True, 0), ("c", False, 5)]


def test_dump_upgrade(spark, tmp_path):
    from hawser.sinks import export

    (tmp_path / "d.json").write_text('{"version": 16, "users": [{"username": "u"}], "event_actions": [{"name": "n", "body": "hi {{Name}}"}]}')
    d = tables.read_dump(spark, str(tmp_path / "d.json"))
    assert d["event_actions"].first()["body"] == "hi {{.Name}}"
    export.dump(d, str(tmp_path / "out"), ["users"])
    assert spark.read.json(str(tmp_path / "out/users")).count() == 1
    assert "".join(export.json_array(spark.range(3), chunk=2)) == '[{"id":0},{"id":1},{"id":2}]'


def test_cron(spark):
    ts = F.lit("2024-01-01 06:00:00").cast("timestamp")  # a Monday
    v = lambda *a: spark.range(1).select(checks.cron_due(ts, *a).alias("v")).first()["v"]
    assert v("*", "*", "*", "*") and v("*/6", "1", "*", "*") and not v("5", "*", "*", "*") and v("6", "2", "*", "1") and not v("6", "2", "*", "*")


def test_streams(spark, tmp_path):
    from hawser.streaming.state import defend_stream, limit_rate_stream, quota_stream

    rows = [("h", i, i * 1000, "UserNotFound") for i in range(12)]
    spark.createDataFrame(rows, "ip string, id long, ts_us long, event string").write.parquet(str(tmp_path / "in"))
    src = lambda: spark.readStream.schema("ip string, id long, ts_us long, event string").parquet(str(tmp_path / "in"))
    d = Defender(threshold=9)
    q = defend_stream(src(), d).writeStream.format("memory").queryName("bans").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = defend(spark.read.parquet(str(tmp_path / "in")), d)
    assert sorted(map(tuple, spark.table("bans").collect())) == sorted(map(tuple, batch.collect()))
    r = RateLimit(5, 1000, 3)
    keyed = lambda f: f.selectExpr("ip AS key", "id", "ts_us")
    q = limit_rate_stream(keyed(src()), r).writeStream.format("memory").queryName("passes").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("passes").collect())) == sorted(map(tuple, limit_rate(keyed(spark.read.parquet(str(tmp_path / "in"))), r).collect()))
    got = []
    deltas = src().selectExpr("ip AS key", "1 AS files", "2 AS size")
    quota_stream(deltas, lambda df, e: got.extend(map(tuple, df.collect())), str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination(120)
    assert got == [("h", 12, 24)]


def test_patterns_of_folders(spark):
    rules = [{"path": "/a", "allowed": ["ok", "*.jpg"], "denied": ["*"], "hide": True}, {"path": "/b", "allowed": ["x.*"], "denied": ["*.zip"]}]
    want = {"/a/ok": True, "/a/ok/any.bin": True, "/a/ok/deep/any.bin": True, "/a/p.jpg": True, "/b/x.zip": True, "/b/y.zip": False, "/b/y.txt": False, "/c/z": True}
    gone = ["/a/no", "/a/no/p.jpg", "/a/no/ok/p.jpg"]
    rows = spark.createDataFrame([(p,) for p in [*want, *gone]], "path string")
    assert {r["path"]: r["allowed"] for r in policy.visible(rows, rules).collect()} == want


def test_actions(spark):
    from hawser.sinks import actions

    e = spark.createDataFrame([(1, "b&b <x>", "/d/a b.txt", "a@x.org, ,c@x.org"), (2, "{{.VirtualPath}}", "/q", None)], "id long, username string, virtual_path string, email string")
    got = actions.mails(e, ["{{.Email}}", "z@x.org"], "S {{.Name}}", "<b>{{.Name}}</b>", html=True).orderBy("id").collect()
    assert got[0]["mail_to"] == ["a@x.org", "c@x.org", "z@x.org"] and got[1]["mail_to"] == ["z@x.org"] and got[0]["mail_bcc"] == []
    assert got[0]["mail_body"] == "<b>b&amp;b &lt;x&gt;</b>" and got[1]["mail_subject"] == "S {{.VirtualPath}}"
    with pytest.raises(ValueError):
        actions.commands(e, "/bin/rm", ["/bin/true"])
    c = actions.commands(e, "/bin/true", ["/bin/true"], ["{{.VirtualPath}}", "-v"], {"WHO": "{{.Name}}"}).orderBy("id").first()
    assert c["command_args"] == ["/d/a b.txt", "-v"] and c["command_env"] == {"WHO": "b&b <x>"}
    ops = actions.file_operations(e, "rename", {"{{.VirtualPath}}": "/old//{{.Name}}/../x"}).orderBy("id").collect()
    assert [(o["source"], o["target"], o["position"]) for o in ops] == [("/d/a b.txt", "/old/x", 0), ("/q", "/old/x", 0)]
    r = actions.http_requests(e, "http://h/?a=1", "GET", "body", query={"p": "{{.VirtualPath}}"})
    assert [x["request_url"] for x in r.orderBy("id").collect()] == ["http://h/?a=1&p=%2Fd%2Fa+b.txt", "http://h/?a=1&p=%2Fq"] and r.first()["request_body"] is None
    sent = actions.delivered(r, "id", lambda rows: [204 if x["id"] == 1 else 500 for x in rows])
    assert sorted(map(tuple, sent.collect())) == [(1, True), (2, False)]


def test_caches(spark):
    from hawser.operators import caches

    now = 10_000_000
    cache = spark.createDataFrame([(f"u{i}", now - i * 600_000) for i in range(12)], "username string, used_at long")
    names = lambda df: {r["username"] for r in df.collect()}
    assert len(names(caches.credentials_kept(cache, now, 12))) == 12
    assert names(caches.credentials_kept(cache, now, 2)) == {f"u{i}" for i in range(7)}  # seven within the hour, below ten
    assert names(caches.credentials_kept(cache, now, 1)) == {"u0"}
    users = spark.createDataFrame([("a", 0), ("b", 5), ("c", 9)], "username string, expiration long")
    assert names(caches.users_cached(users, spark.createDataFrame([("d", 7), ("", 7)], users.schema), 3)) == {"a", "c", "d"}
    assert names(caches.users_cached(users, spark.createDataFrame([("b", 7)], users.schema), 3)) == {"a", "b", "c"}
    assert names(caches.unexpired(users, 6)) == {"a", "c"}


def test_check_of_transfers(spark):
    from hawser.streaming.periodic import transfers_to_close

    t = spark.createDataFrame(
        [("c1", "u", "f", "upload", 60, 0, 0, True), ("c2", "u", "f", "upload", 60, 0, 0, True), ("c3", "u", "f", "upload", 60, 0, 0, False), ("c4", "v", "f", "download", 0, MB, 0, True), ("c5", "v", "f", "download", 0, MB, 0, True)],
        "connection_id string, username string, folder string, kind string, ul long, dl long, truncated long, has_size_limit boolean",
    )
    none = [0] * 5
    users = spark.createDataFrame([("u", 100, 0, *none), ("v", 0, 0, 1, *none[1:])], "username string, quota_size long, used_size long, limit_total long, limit_ul long, limit_dl long, used_ul long, used_dl long")
    got = {(r["connection_id"], r["error"]) for r in transfers_to_close(t, users).collect()}
    assert got == {("c1", "quota exceeded"), ("c2", "quota exceeded"), ("c4", "read quota exceeded"), ("c5", "read quota exceeded")}
    one = t.where("connection_id = 'c1'")
    assert transfers_to_close(one, users) is None and transfers_to_close(one, users, shared=True).count() == 0


def test_admins_from_login(spark):
    from hawser.plans.accounts import admins_from_login, runnable

    admins = spark.createDataFrame([("a", "old", "keep", 1)], "username string, password string, totp_config string, status int")
    logins = spark.createDataFrame([("a",), ('n"w',)], "Name string")
    template, schema = '{"username": "{{.Name}}", "status": 0, "totp_config": "new"}', "username string, password string, totp_config string, status int"
    rows = {r["username"]: r for r in admins_from_login(logins, admins, template, schema, 0).collect()}
    assert (rows["a"]["password"], rows["a"]["totp_config"], rows["a"]["status"]) == ("old", "keep", 0) and rows['n"w']["password"] and rows['n"w']["totp_config"] == "new"
    assert {r["username"]: r["status"] for r in admins_from_login(logins, admins, template, schema, 1).collect()} == {"a": 1, 'n"w': 0}
    tasks = spark.createDataFrame([("t", 0), ("s", 900_000)], "name string, updated_at long")
    assert [r["name"] for r in runnable(tasks, 1_000_000).collect()] == ["t"]


def test_sources(spark, tmp_path):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Listing(BaseHTTPRequestHandler):
        def do_GET(self):
            names = [{"name": "f", "size": 3, "mode": 420, "last_modified": "2024-01-01T00:00:00Z"}, {"name": "d", "size": 0, "mode": (1 << 31) + 493, "last_modified": "2024-01-01T00:00:01Z"}] if self.path == "/readdir/%2Fr%201" else []
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(names).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Listing)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    roots = spark.createDataFrame([("/r 1",), ("/empty",)], "root string")
    got = tables.remote_listing(roots, tables.http_lister(f"http://127.0.0.1:{server.server_port}")).collect()
    server.shutdown()
    assert sorted(map(tuple, got)) == [("/r 1", "d", 0, True, 1704067201000), ("/r 1", "f", 3, False, 1704067200000)]
    sizes = {33: 0, 10: 0, 33 + 40: 8, 33 + 20: 20, 33 + 65568: 65536, 33 + 65568 + 33: 65537}
    rows = spark.createDataFrame([(n,) for n in sizes], "size long")
    assert {r["size"]: r["p"] for r in rows.withColumn("p", tables.decrypted_size(F.col("size"))).collect()} == sizes
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("abc")
    (tmp_path / "y.bin").write_text("d")
    found = {r["path"].rsplit("/", 1)[1]: r["size"] for r in tables.listing(spark, str(tmp_path)).collect()}
    assert found == {"x.txt": 3, "y.bin": 1} and tables.listing(spark, str(tmp_path), "*.txt").count() == 1
    paths_ = spark.createDataFrame([("/a",), ("/a/b/c",), ("/ab",)], "path string")
    assert {r["path"] for r in tables.walk(paths_, "/a").collect()} == {"/a", "/a/b/c"}
    found = checks.existing(spark.createDataFrame([("/a",), ("/no",)], "path string"), paths_)
    assert {r["path"]: r["found"] for r in found.collect()} == {"/a": True, "/no": False}
    log = tmp_path / "log.json"
    log.write_text('{"sender":"Upload","username":"u"}\n{"sender":"login"}\nnot json\n{"sender":"Rename"}\n{"sender":"connection_failed"}\n')
    assert sorted(r["kind"] or "" for r in tables.json_log(spark, str(log)).collect()) == ["", "command", "failed", "login", "transfer"]
    live = spark.createDataFrame([("c", "r1", ["t1", "t2"]), ("e", "", None)], "id string, role string, transfers array<string>")
    assert tables.connections(live).count() == 3 and tables.connections(live, "r1").count() == 2


def test_same_items(spark):
    from hawser.functions import text

    rows = spark.createDataFrame([(["a", "b", "a"], ["b", "a", "a"]), (["a"], ["a", "a"]), ([], []), (["a", "b"], ["a", "a"])], "x array<string>, y array<string>")
    assert [r["v"] for r in rows.select(text.same_items(F.col("x"), F.col("y")).alias("v")).collect()] == [True, False, True, False]
