"""Scalar functions against expected values."""

import pytest
from pyspark.sql import functions as F

from hawser.functions import glob, net, paths, text
from hawser.functions.glob import Pattern


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


GLOBS = [
    ("/mydir/**", ["/mydir", "/mydir/sub", "/mydir/sub/dir"], ["/mydirname"]),
    ("/**/*", ["/mydir", "/mydirname", "/mydir/sub/dir/file.txt"], []),
    ("/**/*.filepart", ["/file.filepart", "/mydir/sub/file.filepart"], ["/file.txt", "/mydir/file.txt"]),
    ("/mydir/**/*.txt", ["/mydir/sub/dir/a.txt"], ["/mydir", "/mydirname/f.txt", "/mydir/sub", "/mydir/sub/dir"]),
    ("*.t?t", ["a.txt", ".tat"], ["a/b.txt", "a.tx"]),
    ("[a-c]x", ["ax", "cx"], ["dx", "x"]),
    ("[^a-c]x", ["dx"], ["ax", "/x"]),
    (r"a\*b", ["a*b"], ["axb"]),
    ("/a/{b,c}/**", ["/a/b", "/a/c/d"], ["/a/d"]),
]


@pytest.mark.parametrize("pattern,yes,no", GLOBS)
def test_glob(spark, pattern, yes, no):
    df = spark.createDataFrame([(p, True) for p in yes] + [(p, False) for p in no], "p string, want boolean")
    c = F.col("p")
    rows = df.select("p", "want", glob.matches(c, Pattern(pattern)).alias("plain"), glob.matches(c, Pattern(pattern, True)).alias("inv")).collect()
    assert all(r["plain"] == r["want"] and r["inv"] != r["want"] for r in rows), rows


def test_bad_glob_matches_nothing(spark):
    for p in ("[a", "a\\", "[]"):
        assert glob.to_regex(p) is None
        assert value(spark, glob.matches(F.lit("a"), Pattern(p))) is False
        assert value(spark, glob.matches(F.lit("a"), Pattern(p, True))) is False


def test_pattern_lists(spark):
    ps = ["/**/*.txt", "/**/*.tmp"]
    for p in ("/mydir/test.tmp", "/mydir/test.txt", "/mydir/sub/test.tmp", "/mydir/sub/test.txt"):
        assert value(spark, glob.matches_list(F.lit(p), [Pattern(x) for x in ps]))
        assert not value(spark, glob.matches_list(F.lit(p), [Pattern(x, True) for x in ps]))
    for p in ("/mydir", "/mydir/test.csv", "/mydir/sub", "/mydir/sub/test.csv"):
        assert not value(spark, glob.matches_list(F.lit(p), [Pattern(x) for x in ps]))
        assert value(spark, glob.matches_list(F.lit(p), [Pattern(x, True) for x in ps]))
    assert value(spark, glob.matches_list(F.lit("x"), []))


def test_group_lists(spark):
    plain, inverse = [Pattern("group1"), Pattern("group2")], [Pattern("group1", True), Pattern("group2", True)]
    for groups, want in ((["group3"], False), (["group1", "group4"], True), (["group1"], True), (["group11"], False)):
        g = F.array(*[F.lit(x) for x in groups])
        assert value(spark, glob.matches_groups(g, plain)) is want
        assert value(spark, glob.matches_groups(g, inverse)) is not want
    assert value(spark, glob.matches_groups(F.lit(None).cast("array<string>"), plain)) is False


@pytest.mark.parametrize("n,iec", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KiB"), (1536, "1.5 KiB"), (1280, "1.2 KiB"), (1408, "1.4 KiB"), (5 << 30, "5.0 GiB"), (123456789, "117.7 MiB")])
def test_sizes(spark, n, iec):
    assert value(spark, text.size_iec(F.lit(n).cast("long"))) == iec == _iec(n)


def _iec(n):
    units = ["B", "KiB", "MiB", "GiB"]
    k = 0
    while n >= 1024 ** (k + 1):
        k += 1
    return f"{n} B" if k == 0 else f"{n / 1024**k:.1f} {units[k]}"


@pytest.mark.parametrize("s,n", [("42", 42), ("42 MB", 42_000_000), ("42 mib", 42 << 20), ("42.5MB", 42_500_000), ("1,005.03 MB", 1005030000), ("12.5 kib", 12800), ("", None), ("42 xb", None), ("9223372036854775808", None), ("x", None), ("1.9", 1)])
def test_parse_size(spark, s, n):
    assert value(spark, text.parse_size(F.lit(s))) == n


def test_durations_and_times(spark):
    assert value(spark, text.duration(F.lit(61_400))) == "01:01"
    assert value(spark, text.duration(F.lit(3_600_000))) == "01:00:00"
    assert value(spark, text.rfc3339_nano(F.lit(1_700_000_000_120_000_000))) == "2023-11-14T22:13:20.12Z"
    assert value(spark, text.rfc3339_nano(F.lit(1_700_000_000_000_000_000))) == "2023-11-14T22:13:20Z"


def test_escapes_and_templates(spark):
    assert value(spark, text.csv_safe(F.lit("=1+1"))) == "'=1+1"
    assert value(spark, text.csv_safe(F.lit("a=1"))) == "a=1"
    assert value(spark, text.json_escaped(F.lit('a"b\n'))) == 'a\\"b\\n'
    assert value(spark, text.html_escaped(F.lit("<a&'>"))) == "&lt;a&amp;&#39;&gt;"
    assert value(spark, text.template("{{.A}}-{{.B}}-{{.C}}", {"A": F.lit("{{.B}}"), "B": F.lit("x")})) == "{{.B}}-x-{{.C}}"
    assert value(spark, text.url_redacted(F.lit("http://u:secret@h/p"))) == "http://u:xxxxx@h/p"


@pytest.mark.parametrize("h,want", [("bytes=0-9", (0, 10)), ("bytes=-5", (95, 5)), ("bytes=90-", (90, 10)), ("bytes=90-500", (90, 10)), ("bytes=5-0", (5, 95)), ("bytes=-0", (None, None)), ("bytes=9-5", (None, None)), ("x", (None, None))])
def test_byte_ranges(spark, h, want):
    a, n = text.byte_range(F.lit(h), F.lit(100))
    assert (value(spark, a), value(spark, n)) == want


@pytest.mark.parametrize("p,want", [("a/b", "/a/b"), ("/a/../b/./c//", "/b/c"), ("\\a\\b", "/a/b"), ("/../..", "/"), ("", "/")])
def test_clean(spark, p, want):
    assert value(spark, paths.clean(F.lit(p))) == want


def test_paths(spark):
    p = F.lit("/a/b/c.tar.gz")
    assert value(spark, paths.ancestors(p)) == ["/a/b/c.tar.gz", "/a/b", "/a", "/"]
    assert [value(spark, f(p)) for f in (paths.base, paths.parent, paths.extension, paths.stem)] == ["c.tar.gz", "/a/b", ".gz", "c.tar"]
    assert value(spark, paths.overlaps(F.lit("/a/b"), F.lit("/a")))
    assert not value(spark, paths.overlaps(F.lit("/ab"), F.lit("/a")))


def test_networks(spark):
    assert value(spark, net.v4(F.lit("::ffff:10.0.0.1"))) == 167772161
    assert value(spark, net.v4(F.lit("10.0.0.256"))) is None
    assert value(spark, net.v4_text(net.last_v4(F.lit("10.0.3.0/25")))) == "10.0.3.127"
    b = spark.createDataFrame([("10.0.0.0/8",), ("2001:db8::/32",), ("bad",)], "c string").select(net.network_bounds("c").alias("b")).collect()
    assert b[0]["b"]["last"] == bytes([10, 255, 255, 255]) and b[1]["b"]["version"] == 6 and b[2]["b"]["first"] is None
    assert value(spark, net.login_allowed(F.lit("x"), F.array(), F.array(F.lit("0.0.0.0/0")))) is True


def test_names_and_addresses(spark):
    ok = lambda c: value(spark, c)
    assert ok(text.name_valid(F.lit("José 7"))) and not ok(text.name_valid(F.lit("a\u0007b"))) and not ok(text.name_valid(F.lit("  ")))
    assert ok(text.email_valid(F.lit("a.b+c@host.example"))) and not ok(text.email_valid(F.lit("a@b"))) and not ok(text.email_valid(F.lit("a b@c.d")))
    assert ok(text.http_class(F.lit(204))) == "ok" and ok(text.http_class(F.lit(302))) == "other"
    assert ok(text.size_si(F.lit(1_234_000).cast("long"))) == "1.234 MB"
    assert ok(text.throttle_wait_ms(F.lit(10240), F.lit(5), F.lit(500))) == 1500
    assert ok(net.bandwidth_for(F.lit("10.0.0.1"), F.array(F.struct(F.array(F.lit("10.0.0.0/8")).alias("sources"), F.lit(9).alias("limit"))), F.lit(1))) == 9


def test_networks_of_both_families_brute_force(spark):
    import ipaddress
    import random

    rng = random.Random(3)
    ips = ["10.0.0.1", "::", "::1", "1::", "2001:db8::8:800:200c:417a", "FE80::1", "::ffff:10.0.0.1", "0:0:0:0:0:ffff:a00:1", "1:2:3:4:5:6:7:8", "255.255.255.255", "1:2:3:4:5:6:7::"]
    ips += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(20)] + [str(ipaddress.IPv6Address(rng.getrandbits(32) << 64)) for _ in range(10)] + [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(20)]
    nets = ["10.0.0.0/8", "::/0", "::/128", "2001:db8::/32", "2001:db8::/31", "fe80::/10", "0.0.0.0/0", "10.0.0.1/32", "1:2:3::/47"]
    nets += [f"{x}/{rng.randrange(0, 33 if '.' in x else 129)}" for x in ips if not x.startswith("::f") and "ffff:a00" not in x]
    rows = [(i, c) for i in ips for c in nets]
    got = spark.createDataFrame(rows, "ip string, cidr string").select(net.in_cidr(F.col("ip"), F.col("cidr")).alias("v")).collect()

    def want(i, c):
        a, n = ipaddress.ip_address(i), ipaddress.ip_network(c, strict=False)
        a = a.ipv4_mapped or a if a.version == 6 else a
        return a.version == n.version and a in n

    assert [r["v"] for r in got] == [want(i, c) for i, c in rows]
    bad = ["x", "", "1.2.3", "1.2.3.4.5", "1:2:3:4:5:6:7", "1::2::3", "12345::", ":1", "1:2:3:4:5:6:7:8:9", "g::", "10.0.0.0/33", "::/129", "10.0.0.0/", "10.0.0.0/x", None]
    frame = spark.createDataFrame([(b,) for b in bad], "s string")
    assert frame.where(net.network(F.col("s"), bare=True).isNotNull()).count() == 0


def test_login_allowed_by_either_family(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    v = lambda ip, ok, no: value(spark, net.login_allowed(F.lit(ip), ok, no))
    assert v("2001:db8::1", a(), a("2001:db8::/32")) is False and v("2001:db9::1", a(), a("2001:db8::/32")) is True
    assert v("10.0.0.1", a("10.0.0.0/8", "bad"), a()) is True and v("10.0.0.1", a("bad", "10.0.0.0/8"), a()) is False
    assert v("11.0.0.1", a("10.0.0.0/8"), a()) is False and v("11.0.0.1", a(), a("bad")) is False and v("11.0.0.1", a(), a()) is True


def test_go_duration(spark):
    for ms, want in ((0, "0s"), (977, "977ms"), (1000, "1s"), (1500, "1.5s"), (90500, "1m30.5s"), (120000, "2m0s"), (3600000, "1h0m0s"), (3661050, "1h1m1.05s")):
        assert value(spark, text.go_duration(F.lit(ms))) == want
