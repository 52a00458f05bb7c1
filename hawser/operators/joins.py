"""Joins: nested children, reverse lookups, nearest ancestor, longest prefix, rules against events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net, paths


def with_children(parents: DataFrame, children: DataFrame, key: str, order: list[str], name: str, columns: list[str]) -> DataFrame:
    """Each parent with its children as an array of structs in the order given; none: an empty array. Filter and limit the
    parents before."""
    item = F.struct(*order, *[c for c in columns if c not in order])
    nested = children.join(parents.select(key), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(name))
    kind = nested.schema[name].dataType
    return parents.join(nested, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def members(links: DataFrame, owner: str, member: str, name: str = "members") -> DataFrame:
    """Reverse lookup: each owner with its members, sorted, without repeats."""
    return links.where(F.col(member).isNotNull()).groupBy(owner).agg(F.array_sort(F.collect_set(member)).alias(name))


def nearest_policy(rows: DataFrame, policies: DataFrame, path: str = "path", policy_path: str = "policy_path", also: list[str] | None = None) -> DataFrame:
    """Each row with the policy of its deepest ancestor (itself included); rows without one stay, with nulls. Distinct paths are
    found their policy once: their ancestors are exploded and joined by equality, so neither side need be small; ``also``
    names further equal keys, such as the user."""
    keys = [*(also or []), path]
    each = rows.select(*keys).distinct()
    steps = each.select(*[F.col(k).alias(f"__{k}") for k in keys], *(also or []), F.posexplode(paths.ancestors(F.col(path))).alias("__up", policy_path))
    extra = [c for c in policies.columns if c not in (policy_path, *(also or []))]
    best = steps.join(policies, [policy_path, *(also or [])]).groupBy(*[f"__{k}" for k in keys]).agg(F.min_by(F.struct(policy_path, *extra), "__up").alias("__p"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k) == F.col(f"__{k}")
    return rows.join(best, same, "left").select(*rows.columns, "__p.*")


def longest_prefix(addresses: DataFrame, entries: DataFrame, ip: str = "ip", protocol: str | None = None) -> DataFrame:
    """Each address with the mode of the longest network that holds it and admits its protocol; none: null. entries:
    cidr, mode, protocols; malformed networks hold nothing. Networks of both families are joined by equality of (length,
    first bits), one probe for each length in use."""
    e = entries.withColumn("__n", net.network(F.col("cidr"), bare=True)).where("__n is not null")
    e = e.select(F.col("__n.bits").alias("bits"), net.masked(F.col("__n.net"), F.col("__n.bits")).alias("net"), F.left("__n.net", F.lit(1)).alias("family"), "cidr", "mode", net.protocol_bits(F.col("protocols")).alias("protocols"))
    lengths = sorted((r["family"], r["bits"]) for r in e.select("family", "bits").distinct().collect())  # at most 33 + 129
    keys = [ip, *([protocol] if protocol else [])]
    probes = addresses.select(*keys).distinct().withColumn("__at", net.address(F.col(ip))).where("__at is not null")
    in_use = lambda f: F.array(*[F.lit(b) for g, b in lengths if g == f]).cast("array<int>")
    probes = probes.withColumn("bits", F.explode(F.when(F.startswith("__at", F.lit("4")), in_use("4")).otherwise(in_use("6")))).withColumn("net", net.masked(F.col("__at"), F.col("bits")))
    hits = probes.join(e, ["bits", "net"])
    if protocol:
        hits = hits.where(net.has_protocol(F.col("protocols"), F.col(protocol)))
    best = hits.groupBy(*keys).agg(F.max_by(F.struct("mode", "cidr"), F.struct("bits", F.col("cidr"))).alias("__b"))
    return addresses.join(best, keys, "left").select(*addresses.columns, F.col("__b.mode").alias("mode"), F.col("__b.cidr").alias("cidr"))


def without_match(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_anti")


def with_match(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_semi")


def resolve_key(rows: DataFrame, dimension: DataFrame, name: str, key: str, out: str, default: Column | None = None) -> DataFrame:
    """Foreign key by name; unknown names get the default (null)."""
    d = dimension.select(F.col(name), F.col(key).alias(out))
    joined = rows.join(d, name, "left")
    return joined.withColumn(out, F.coalesce(out, default)) if default is not None else joined


def permissions_for(rows: DataFrame, permissions: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Permissions of the nearest listed ancestor directory. permissions: policy_path, permissions (array)."""
    return nearest_policy(rows, permissions, also=also)


def shadowed(entries: DataFrame, mounts: DataFrame) -> DataFrame:
    """Directory entries not hidden by a virtual mount of the same path, plus the mounts. entries and mounts: path, ..."""
    return entries.join(mounts.select("path"), "path", "left_anti").unionByName(mounts, allowMissingColumns=True)


def screened(events: DataFrame, entries: DataFrame, ip: str = "ip", protocol: str | None = "protocol") -> DataFrame:
    """Events with a verdict from the lists (mode 1 allow, 2 deny; the longest prefix decides): ``safe``, ``denied`` or ``scored``.
    Only the last kind is for the abuse detector."""
    found = longest_prefix(events, entries, ip, protocol)
    return found.withColumn("verdict", F.when(F.col("mode") == 1, "safe").when(F.col("mode") == 2, "denied").otherwise("scored")).drop("mode", "cidr")
