"""Addresses and networks. Of either family as text: "4" or "6" and the address in hex digits, of which a network keeps its first
bits; IPv4 also as a long, and bounds of networks as bytes through a pandas UDF."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Protocol bits; 0 stands for all.
PROTOCOLS = {"SSH": 1, "FTP": 2, "DAV": 4, "HTTP": 8}
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
_V4 = rf"^(?i:::ffff:)?{_OCTET}(?:\.{_OCTET}){{3}}$"


def v4(ip: Column) -> Column:
    """Long value of a dotted or IPv4-mapped address; null for anything else."""
    parts = F.split(F.regexp_replace(ip, "^(?i:::ffff:)", ""), r"\.")
    return F.when(ip.rlike(_V4), F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n * 256 + x.cast("long")))


def v4_text(n: Column) -> Column:
    return F.concat_ws(".", *[F.shiftrightunsigned(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def prefix_length(cidr: Column) -> Column:
    """Bits of an IPv4 network; a bare address has 32."""
    bits = F.regexp_extract(cidr, r"/(\d{1,2})$", 1)
    return F.when(F.contains(cidr, F.lit("/")), bits.try_cast("int")).otherwise(F.lit(32))


def mask(n: Column, bits: Column) -> Column:
    """The network address of n at a prefix length."""
    step = F.pow(F.lit(2.0), 32 - bits).cast("long")
    return n - n % step


def first_v4(cidr: Column) -> Column:
    return mask(v4(F.element_at(F.split(cidr, "/"), 1)), prefix_length(cidr))


def last_v4(cidr: Column) -> Column:
    return first_v4(cidr) + F.pow(F.lit(2.0), 32 - prefix_length(cidr)).cast("long") - 1


_GROUP = r"[0-9a-f]{1,4}"
_V6, _V6_SHORT = rf"^(?:{_GROUP}:){{7}}{_GROUP}$", rf"^(?:{_GROUP}(?::{_GROUP})*)?::(?:{_GROUP}(?::{_GROUP})*)?$"


def _once(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it stands in the result."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def address(ip: Column) -> Column:
    """The family and the address in hex digits (8 or 32 of them); null for anything that is no address. Mapped IPv4 is IPv4."""
    low = F.lower(ip)
    halves = F.split(low, "::")
    groups = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    four = lambda gs: F.transform(gs, lambda g: F.lpad(g, 4, "0"))

    def long(x):
        n = F.size(x["a"]) + F.size(x["z"])
        digits = F.array_join(F.concat(four(x["a"]), F.array_repeat(F.lit("0000"), F.greatest(8 - n, F.lit(0))), four(x["z"])), "")
        return F.when(low.rlike(_V6) | (n <= 7), digits)

    mapped = lambda d: F.when(F.startswith(d, F.lit("0" * 20 + "ffff")), F.concat(F.lit("4"), F.substring(d, 25, 8))).otherwise(F.concat(F.lit("6"), d))
    six = F.when(low.rlike(_V6) | low.rlike(_V6_SHORT), _once(_once(F.struct(groups(0).alias("a"), groups(1).alias("z")), long), mapped))
    return _once(v4(ip), lambda n: F.when(n.isNotNull(), F.concat(F.lit("4"), F.lpad(F.lower(F.hex(n)), 8, "0"))).otherwise(six))


def masked(at: Column, bits: Column) -> Column:
    """The first bits of an address, with its family."""
    whole, rest = F.floor(bits / 4).cast("int"), (bits % 4).cast("int")
    digit = F.conv(F.substring(at, whole + 2, F.lit(1)), 16, 10).cast("int")
    kept = digit - digit % F.pow(F.lit(2), 4 - rest).cast("int")
    return F.concat(F.substring(at, F.lit(1), whole + 1), F.when(rest > 0, F.lower(F.hex(kept.cast("long")))).otherwise(""))


def network(cidr: Column, bare: bool = False) -> Column:
    """struct(net: family and address, bits) of a network; null if malformed. A bare address is one only where allowed."""

    def of(at):
        parts = F.split(cidr, "/")
        four = F.startswith(at, F.lit("4"))
        most = F.when(four, 32).otherwise(128)
        stated = F.when(F.get(parts, F.lit(1)).rlike("^[0-9]{1,3}$"), F.get(parts, F.lit(1)).cast("int"))
        # A mapped network is written in IPv6 bits.
        bits = F.when(F.size(parts) == 2, stated - F.when(four & F.contains(cidr, F.lit(":")), 96).otherwise(0))
        if bare:
            bits = F.when(F.size(parts) == 1, most).otherwise(bits)
        return _once(bits, lambda n: F.when(at.isNotNull() & n.between(0, most), F.struct(at.alias("net"), n.alias("bits"))))

    return _once(address(F.get(F.split(cidr, "/"), F.lit(0))), of)


def _holds(at: Column, n: Column) -> Column:
    return F.coalesce(masked(at, n["bits"]) == masked(n["net"], n["bits"]), F.lit(False))


def in_cidr(ip: Column, cidr: Column, bare: bool = True) -> Column:
    """Null cidr, malformed cidr or address, or another family: false."""
    return _once(F.struct(address(ip).alias("at"), network(cidr, bare).alias("n")), lambda x: _holds(x["at"], x["n"]))


def in_any(ip: Column, cidrs: Column) -> Column:
    return _once(address(ip), lambda at: F.coalesce(F.exists(cidrs, lambda c: _once(network(c, bare=True), lambda n: _holds(at, n))), F.lit(False)))


def protocol_bits(mask_: Column) -> Column:
    """Bits that are set beyond the known four, or none, mean all."""
    return F.when((mask_ <= 0) | (mask_ >= 15), F.lit(0)).otherwise(mask_)


def has_protocol(mask_: Column, protocol: Column | str) -> Column:
    if isinstance(protocol, str):
        return (mask_ == 0) | (mask_.bitwiseAND(PROTOCOLS.get(protocol, 0)) != 0)
    bit = F.lit(0)
    for k, v in PROTOCOLS.items():
        bit = F.when(protocol == k, v).otherwise(bit)
    return (mask_ == 0) | (mask_.bitwiseAND(bit) != 0)


@F.pandas_udf(T.StructType([T.StructField("first", T.BinaryType()), T.StructField("last", T.BinaryType()), T.StructField("version", T.IntegerType())]))
def network_bounds(s: pd.Series) -> pd.DataFrame:
    """First and last address of a network, IPv4 (mapped ones too) in 4 bytes, IPv6 in 16; nulls for malformed text."""

    def one(x):
        try:
            n = ipaddress.ip_network(x, strict=False)
        except (ValueError, TypeError):
            return None, None, None
        a, z = n.network_address, n.broadcast_address
        if n.version == 6 and a.ipv4_mapped and n.prefixlen >= 96:
            a, z = a.ipv4_mapped, z.ipv4_mapped
        return a.packed, z.packed, a.version

    return pd.DataFrame([one(x) for x in s], columns=["first", "last", "version"]).astype({"version": "Int32"})


def login_allowed(ip: Column, allowed: Column, denied: Column) -> Column:
    """Allowed networks in turn, then denied ones; the first that holds the address decides, and a malformed one refuses. Else
    allowed exactly where no allow list is set. An unreadable address is let through."""
    none = F.array().cast("array<string>")
    allowed, denied = F.coalesce(allowed.cast("array<string>"), none), F.coalesce(denied.cast("array<string>"), none)

    def decide(at):
        says = lambda c: _once(network(c), lambda n: F.when(n.isNull(), False).when(_holds(at, n), True))
        first = F.filter(F.transform(allowed, says), lambda v: v.isNotNull())
        refused = F.exists(denied, lambda c: _once(network(c), lambda n: n.isNull() | _holds(at, n)))
        return F.when(at.isNull(), True).when(F.size(first) > 0, F.get(first, F.lit(0))).when(refused, False).otherwise(F.size(allowed) == 0)

    return _once(address(ip), decide)


def bandwidth_for(ip: Column, rules: Column, default: Column) -> Column:
    """The first rule (struct: sources, limit) whose networks hold the address, else the default."""
    hit = F.filter(rules, lambda r: in_any(ip, r["sources"]))
    return F.when(F.size(hit) > 0, F.get(hit, F.lit(0))["limit"]).otherwise(default)
