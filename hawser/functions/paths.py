"""Virtual paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(path: Column) -> Column:
    """Absolute path: backslashes as slashes, ``.``, ``..`` and empty parts resolved; never above ``/``."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(p != "..", F.concat(done, F.array(p))).otherwise(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def ancestors(path: Column) -> Column:
    """The clean path itself and all directories above it, deepest first, ``/`` last."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    up = F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.when(F.size(parts) > 0, up).otherwise(F.array(F.lit("/")))


def depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda p: p != ""))


def base(path: Column) -> Column:
    return F.when(path == "/", F.lit("/")).otherwise(F.element_at(F.split(path, "/"), -1))


def parent(path: Column) -> Column:
    up = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(up == "", F.lit("/")).otherwise(up)


def extension(path: Column) -> Column:
    """From the last dot of the last part, dot included; empty where there is none."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def stem(path: Column) -> Column:
    b = base(path)
    return F.substring(b, F.lit(1), F.length(b) - F.length(extension(path)))


def overlaps(a: Column, b: Column) -> Column:
    """One is the other or lies below it."""
    under = lambda x, y: F.startswith(x, F.when(y == "/", F.lit("/")).otherwise(F.concat(y, F.lit("/"))))
    return (a == b) | under(a, b) | under(b, a)


def has_prefix_in(value: Column, prefixes: Column) -> Column:
    return F.exists(prefixes, lambda p: F.startswith(value, p))


def url_path(url: Column) -> Column:
    """The path part of a URL: no scheme, host, query or fragment."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.when(bare == "", F.lit("/")).otherwise(bare)
