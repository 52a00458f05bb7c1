"""Sizes, durations, times, escapes and labels as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit letters from 2^10 (10^3) on.
_UNITS = "KMGTPE"


def _tenths(n: Column, unit: int) -> Column:
    """n / unit with one decimal: rounded to nearest, exact ties to even, as C's printf of the exact quotient."""
    rest = n % F.lit(unit)
    whole = (n - rest) / F.lit(unit)
    scaled = rest * 10
    low = ((scaled - scaled % F.lit(unit)) / F.lit(unit)).cast("long")
    over = (scaled % F.lit(unit)) * 2
    up = F.when(over > unit, 1).when((over == unit) & (low % 2 == 1), 1).otherwise(0)
    tenths = whole.cast("long") * 10 + low + up
    return F.concat(F.floor(tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"))


def size_iec(n: Column) -> Column:
    """Bytes as text with units of 1024: ``0 B``, ``1.5 KiB``."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, u in enumerate(_UNITS[:5], 1):
        out = F.when(n >= 1024**k, F.concat(_tenths(n, 1024**k), F.lit(f" {u}iB"))).otherwise(out)
    return out


def size_si(n: Column) -> Column:
    """Bytes as text with units of 1000 and as many decimals as it takes (at most six)."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, u in enumerate(_UNITS[:5], 1):
        shown = F.regexp_replace(F.format_string("%.6f", n / F.lit(1000.0**k)), r"\.?0+$", "")
        out = F.when(n >= 1000**k, F.concat(shown, F.lit(f" {u}B"))).otherwise(out)
    return out


def parse_size(s: Column) -> Column:
    """Text to bytes: ``42 MB`` (1000), ``42 mib`` (1024), commas dropped, no unit: bytes; the fraction of a byte is cut
    off. Unknown units, malformed numbers and 2^63 or more: null."""
    t = F.lower(F.regexp_replace(s, ",", ""))
    shape = r"^\s*([0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*([a-z]*)\s*$"
    number, unit = F.regexp_extract(t, shape, 1), F.regexp_extract(t, shape, 2)
    factor = F.when(unit.isin("", "b"), F.lit(1.0))
    for k, u in enumerate(_UNITS.lower(), 1):
        factor = factor.when(unit.isin(u, f"{u}b"), F.lit(1000.0**k)).when(unit.isin(f"{u}i", f"{u}ib"), F.lit(1024.0**k))
    value = F.when(number != "", number.cast("double")) * factor
    return F.when(value < 2.0**63, F.floor(value).cast("long"))


def go_duration(ms: Column) -> Column:
    """Milliseconds as in 977ms, 1.5s, 2m0.25s, 1h0m0s; 0s for none."""
    sec, part = F.floor(ms / 1000).cast("long"), (ms % 1000).cast("long")
    hours, minutes, rest = F.floor(sec / 3600).cast("long"), F.floor(sec % 3600 / 60).cast("long"), sec % 60
    tail = F.concat(rest.cast("string"), F.when(part > 0, F.concat(F.lit("."), F.rtrim(F.lpad(part.cast("string"), 3, "0"), F.lit("0")))).otherwise(""), F.lit("s"))
    long = F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"))).otherwise(""), F.when(sec >= 60, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(""), tail)
    return F.when(ms <= 0, "0s").when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(long)


def duration(ms: Column) -> Column:
    """Milliseconds as MM:SS, or HH:MM:SS from one hour on; rounded to the second."""
    sec = F.floor((ms + 500) / 1000).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours, rest = F.floor(sec / 3600).cast("long"), sec % 3600
    tail = F.concat(two(F.floor(rest / 60).cast("long")), F.lit(":"), two(rest % 60))
    return F.when(hours > 0, F.concat(F.when(hours < 10, two(hours)).otherwise(hours.cast("string")), F.lit(":"), tail)).otherwise(tail)


def rfc3339_nano(ns: Column) -> Column:
    """UTC text of a nanosecond epoch, zeros at the end of the fraction trimmed."""
    nano = F.pmod(ns, F.lit(1_000_000_000))
    day = F.date_format(F.timestamp_seconds((ns - nano) / F.lit(1_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.regexp_replace(F.lpad(nano.cast("string"), 9, "0"), "0+$", "")
    return F.concat(day, F.when(nano > 0, F.concat(F.lit("."), fraction)).otherwise(F.lit("")), F.lit("Z"))


def millis_text(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS")


def date_parts(ms: Column) -> dict[str, Column]:
    t = F.timestamp_millis(ms)
    return {k: F.date_format(t, f) for k, f in {"Year": "yyyy", "Month": "MM", "Day": "dd", "Hour": "HH", "Minute": "mm"}.items()}


def csv_safe(s: Column) -> Column:
    """A leading quote where a spreadsheet would read the cell as a formula."""
    return F.when(F.rlike(s, F.lit(r"^[=+\-@\t\r]")), F.concat(F.lit("'"), s)).otherwise(s)


def json_escaped(s: Column) -> Column:
    """The string as it stands between the quotes of a JSON string."""
    quoted = F.to_json(F.struct(s.alias("v")))
    return F.substring(quoted, F.lit(7), F.length(quoted) - 8)


def html_escaped(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def url_query_escaped(s: Column) -> Column:
    """As a value of a URL's query: spaces as ``+``; letters, digits and ``-_.~`` as they are."""
    return F.replace(F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def same_items(a: Column, b: Column) -> Column:
    """Whether two lists hold the same elements as often, in any order."""
    return F.array_sort(a) == F.array_sort(b)


def status_label(status: Column) -> Column:
    return F.when(status == 1, "OK").when(status == 2, "KO").when(status == 3, "Quota exceeded").otherwise("")


def status_binary(status: Column) -> Column:
    return F.when(status == 1, "OK").otherwise("KO")


#: Labels of log events.
LOG_EVENTS = {1: "Login failed", 2: "Login with non-existent user", 3: "No login tried", 4: "Algorithm negotiation failed", 5: "Login succeeded"}


def log_event_label(event: Column) -> Column:
    out = F.lit("")
    for k, v in LOG_EVENTS.items():
        out = F.when(event == k, v).otherwise(out)
    return out


def http_class(status: Column) -> Column:
    return F.when(status.between(200, 299), "ok").when(status.between(400, 499), "client_error").when(status >= 500, "server_error").otherwise("other")


def hashes(content: Column) -> dict[str, Column]:
    return {"md5": F.md5(content), "sha1": F.sha1(content), "sha256": F.sha2(content, 256), "sha384": F.sha2(content, 384), "sha512": F.sha2(content, 512)}


def hex_id(s: Column) -> Column:
    return F.lower(F.hex(s))


def byte_range(header: Column, size: Column) -> tuple[Column, Column]:
    """Start and length of ``bytes=a-b``, ``a-`` and ``-n``; the end is clamped to the size, ``a-0`` is open. Null: rejected."""
    shape = r"^bytes=([0-9]*)-([0-9]*)$"
    a, b = F.regexp_extract(header, shape, 1), F.regexp_extract(header, shape, 2)
    first, last = F.when(a != "", a.cast("long")), F.when(b != "", b.cast("long"))
    suffix = first.isNull() & (last > 0)
    start = F.when(suffix, F.greatest(size - last, F.lit(0))).otherwise(first)
    end = F.when(suffix | last.isNull() | (last == 0), size - 1).otherwise(F.least(last, size - 1))
    length = end - start + 1
    ok = header.rlike(shape) & start.isNotNull() & (length > 0)
    return F.when(ok, start), F.when(ok, length)


def name_valid(s: Column) -> Column:
    """No control, format, private-use, surrogate or unassigned characters, no line separators, not blank."""
    return (F.trim(s) != "") & ~s.rlike(r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}\p{Cn}\p{Zl}\p{Zp}]")


def email_valid(s: Column) -> Column:
    return s.rlike(r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+$") & (F.length(s) <= 254)


def url_redacted(s: Column) -> Column:
    return F.regexp_replace(s, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/:@]*):[^/@]*@", "$1:xxxxx@")


def throttle_wait_ms(bytes_: Column, kib_per_s: Column, elapsed_ms: Column) -> Column:
    """Milliseconds to wait to hold the bandwidth; 0 where there is none to wait."""
    kib = F.floor(bytes_ / 1024).cast("long")
    wait = F.floor(1000 * kib / F.nullif(kib_per_s, F.lit(0))).cast("long") - elapsed_ms
    return F.coalesce(F.greatest(wait, F.lit(0)), F.lit(0)).cast("long")


def template(source: str, values: dict[str, Column], escape=None, raw: tuple[str, ...] = ()) -> Column:
    """``{{.Name}}`` tokens replaced all at once (a value that holds a token is not replaced again); unknown tokens stay. The
    values of the tokens in ``raw`` are not escaped."""
    parts = []
    for piece in re.split(r"(\{\{\.\w+\}\})", source):
        m = re.fullmatch(r"\{\{\.(\w+)\}\}", piece)
        if m and m[1] in values:
            v = F.coalesce(values[m[1]].cast("string"), F.lit(""))
            parts.append(escape(v) if escape and m[1] not in raw else v)
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


#: Tokens of an event and the columns they show.
TOKENS = {
    "Name": "username", "Event": "action", "Status": "status", "VirtualPath": "virtual_path", "FsPath": "fs_path", "VirtualTargetPath": "virtual_target_path", "FsTargetPath": "fs_target_path",
    "ObjectName": "object_name", "ObjectType": "object_type", "FileSize": "file_size", "Elapsed": "elapsed", "Protocol": "protocol", "IP": "ip", "Role": "role", "Email": "email",
    "Timestamp": "timestamp", "UID": "uid", "Ext": "extension", "ObjectData": "object_data", "Metadata": "metadata",
}
#: Tokens whose values are JSON already or escaped for it.
RAW_TOKENS = ("ObjectData", "ObjectDataString", "Metadata", "MetadataString")
_NUMBERS = ("Status", "FileSize", "Elapsed", "Timestamp")


def event_tokens(columns: list[str]) -> dict[str, Column]:
    """Values of every token over a view of events; columns that the view lacks count as empty (numbers as 0, data as ``{}``).
    ``idp_<field>`` columns give ``IDPField<field>``, ``errors`` (a list) gives ErrorString. Directories of paths that are
    empty leave their tokens as they stand."""
    from . import paths

    have = lambda c, empty: F.coalesce(F.col(c).cast("string"), F.lit(empty)) if c in columns else F.lit(empty)
    out = {t: have(c, "0" if t in _NUMBERS else "") for t, c in TOKENS.items()}
    ms = F.expr("(timestamp - pmod(timestamp, 1000000L)) div 1000000L") if "timestamp" in columns else F.lit(0).cast("long")
    out |= date_parts(ms) | {"DateTime": millis_text(ms), "StatusString": status_binary(out["Status"].cast("int"))}
    name, ext = out["ObjectName"], out["Ext"]
    ends = (ext != "") & F.endswith(name, ext)
    out["ObjectBaseName"] = F.when(ends, F.substring(name, F.lit(1), F.length(name) - F.length(ext))).otherwise(name)
    out["EscapedVirtualPath"] = url_query_escaped(out["VirtualPath"])
    at = lambda p, value, token: F.when(p != "", value).otherwise(F.lit("{{." + token + "}}"))
    path, target = out["VirtualPath"], out["VirtualTargetPath"]
    out["VirtualDirPath"] = at(path, paths.parent(path), "VirtualDirPath")
    out["VirtualTargetDirPath"] = at(target, paths.parent(target), "VirtualTargetDirPath")
    out["TargetName"] = at(target, paths.base(target), "TargetName")
    out["ErrorString"] = F.coalesce(F.array_join("errors", ", "), F.lit("")) if "errors" in columns else F.lit("")
    for t in ("ObjectData", "Metadata"):
        data = out[t]
        out[t], out[f"{t}String"] = F.when(data != "", data).otherwise("{}"), json_escaped(data)
    return out | {f"IDPField{c.removeprefix('idp_')}": F.col(c) for c in columns if c.startswith("idp_")}
