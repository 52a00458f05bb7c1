"""Group settings merged into users, and access decisions that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import glob, paths

DAY_MS = 86_400_000
#: Settings that are taken from the primary group where the user's is 0 (numbers) or empty (text).
FILLED_NUMBERS = ["quota_size", "quota_files", "max_sessions", "upload_bandwidth", "download_bandwidth"]
FILLED_TEXT = ["home_dir"]
TRANSFER = ["upload_data_transfer", "download_data_transfer", "total_data_transfer"]


def merge_primary(users: DataFrame, groups: DataFrame) -> DataFrame:
    """Each user with the primary group's settings where it has none of its own. Transfer limits are one unit: they are
    filled only if all three are 0. A group's days of validity count from the user's creation. Columns missing on either
    side are left alone. users: group_name; groups: name."""
    g = groups.select([F.col(c).alias(f"g_{c}") for c in groups.columns])
    j = users.join(g, F.col("group_name") == F.col("g_name"), "left")
    has = lambda c: c in users.columns and c in groups.columns
    out = {}
    for c in filter(has, FILLED_NUMBERS):
        out[c] = F.coalesce(F.nullif(F.col(c), F.lit(0)), F.col(f"g_{c}"), F.lit(0)).cast(users.schema[c].dataType)
    for c in filter(has, FILLED_TEXT):
        out[c] = F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"g_{c}"), F.lit(""))
    limits = [c for c in TRANSFER if has(c)]
    if limits:
        unset = F.lit(True)
        for c in limits:
            unset &= F.coalesce(F.col(c), F.lit(0)) == 0
        for c in limits:
            out[c] = F.when(unset, F.coalesce(F.col(f"g_{c}"), F.lit(0))).otherwise(F.col(c)).cast(users.schema[c].dataType)
    if "expiration_date" in users.columns and "expires_in" in groups.columns:
        due = F.when((F.col("created_at") > 0) & (F.col("g_expires_in") > 0), F.col("created_at") + F.col("g_expires_in").cast("long") * DAY_MS)
        out["expiration_date"] = F.coalesce(F.nullif(F.col("expiration_date"), F.lit(0)), due, F.lit(0)).cast("long")
    return j.select(*[out[c].alias(c) if c in out else F.col(c) for c in users.columns])


def merge_lists(own: Column, primary: Column, *secondary: Column) -> Column:
    """User's list, then the primary group's, then the secondaries' in their order; the first of equals stays."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(c, empty) for c in (own, primary, *secondary)]))


def merge_maps(own: Column, other: Column, primary: bool = False, root: str = "/") -> Column:
    """Keys of the user win; a primary group's entry for ``/`` wins over the user's, a secondary's is left out."""
    none = F.map_filter(own, lambda k, v: F.lit(False))
    own, other = F.coalesce(own, none), F.coalesce(other, none)
    kept = F.map_filter(own, lambda k, v: ~(F.lit(primary) & (k == root) & F.map_contains_key(other, F.lit(root))))
    new = F.map_filter(other, lambda k, v: ~F.map_contains_key(own, k) & (k != root) if not primary else (~F.map_contains_key(own, k) | (k == root)))
    return F.map_concat(kept, new)


def apply_groups(own: Column, groups: Column) -> Column:
    """Lists over an array of struct(type, sort_order, values): type 1 (primary) first, then 2 (secondary) in order; 3
    (membership) is ignored."""
    used = F.array_sort(F.filter(groups, lambda g: g["type"].isin(1, 2)), lambda a, b: F.when(a["type"] != b["type"], a["type"] - b["type"]).otherwise(a["sort_order"] - b["sort_order"]))
    return F.array_distinct(F.concat(own, F.flatten(F.transform(used, lambda g: g["values"]))))


def account_usable(now_ms: Column) -> Column:
    return (F.col("status") >= 1) & ((F.col("expiration_date") == 0) | (F.col("expiration_date") >= now_ms))


def in_access_window(at: Column, windows: Column) -> Column:
    """windows: array of struct(day 0 = Sunday, from, to as HH:MM), both ends inclusive; none: always. at: UTC timestamp."""
    day, clock = F.dayofweek(at) - 1, F.date_format(at, "HH:mm")
    return (F.coalesce(F.size(windows), F.lit(0)) <= 0) | F.exists(windows, lambda w: (w["day"] == day) & (w["from"] <= clock) & (w["to"] >= clock))


def share_usable(now_ms: Column, ip: Column) -> Column:
    """Tokens left, not expired, and the address admitted (malformed networks never match)."""
    from ..functions import net

    tokens = (F.col("max_tokens") == 0) | (F.col("used_tokens") < F.col("max_tokens"))
    fresh = (F.col("expires_at") == 0) | (F.col("expires_at") >= now_ms)
    return tokens & fresh & ((F.coalesce(F.size("allow_from"), F.lit(0)) <= 0) | net.in_any(ip, F.col("allow_from")))


def file_allowed(name: Column, allowed: list[str], denied: list[str]) -> Column:
    """Name against allow, then deny patterns (any case); an allow list denies what neither names."""
    low = F.lower(name)

    def hit(patterns: list[str]) -> Column:
        found = F.lit(False)
        for p in patterns:
            if regex := glob.to_regex(p.lower()):
                found = found | low.rlike(regex)
        return found

    return F.when(hit(allowed), True).when(hit(denied), False).otherwise(not allowed)


def _nearest_rule(folder: Column, rules: list[dict], none: Column, verdict) -> Column:
    """verdict(rule) of the deepest rule at or above a folder, ``none`` without one. A rule that denies everything but what it
    allows says nothing below the directories that it allows by name."""
    out, parts = none, F.filter(F.split(folder, "/"), lambda p: p != "")
    for r in sorted(rules, key=lambda r: _depth(r["path"])):
        at, says = r["path"], verdict(r)
        if r.get("allowed") and r.get("denied", [])[:1] == ["*"]:
            child = F.get(parts, F.lit(_depth(at)))
            says = F.when(child.isNotNull() & file_allowed(child, r["allowed"], r["denied"]), none).otherwise(says)
        out = F.when(F.lit(at == "/") | (folder == at) | F.startswith(folder, F.lit(at + "/")), says).otherwise(out)
    return out


def _depth(path: str) -> int:
    return len([p for p in path.split("/") if p])


def visible(entries: DataFrame, rules: list[dict]) -> DataFrame:
    """Directory entries after the file patterns of their nearest ruled directory. rules: path, allowed, denied, hide
    (hidden entries go, with all below a directory that a rule above hides; others stay, flagged not allowed)."""
    folder, name = paths.parent(F.col("path")), paths.base(F.col("path"))
    ok = _nearest_rule(folder, rules, F.lit(True), lambda r: file_allowed(name, r.get("allowed", []), r.get("denied", [])))
    hide = _nearest_rule(folder, rules, F.lit(False), lambda r: F.lit(bool(r.get("hide"))))

    def hidden(d: Column) -> Column:
        no = F.lit(False)
        return _nearest_rule(d, rules, no, lambda r: (d != r["path"]) & ~file_allowed(paths.base(d), r.get("allowed", []), r.get("denied", [])) if r.get("hide") else no)

    gone = F.exists(F.filter(paths.ancestors(folder), lambda d: d != "/"), hidden) if any(r.get("hide") for r in rules) else F.lit(False)
    return entries.withColumn("allowed", ok).where(~gone & (F.col("allowed") | ~hide))


def has_upload_space(limit_ul: Column, used_ul: Column, limit_total: Column, used_total: Column) -> Column:
    """Whether something is left of the total limit or, if there is none (0 or less), of the upload limit."""
    return F.when(limit_total > 0, used_total < limit_total).otherwise((limit_ul <= 0) | (used_ul < limit_ul))


def has_download_space(limit_dl: Column, used_dl: Column, limit_total: Column, used_total: Column) -> Column:
    """The same for downloads."""
    return has_upload_space(limit_dl, used_dl, limit_total, used_total)
