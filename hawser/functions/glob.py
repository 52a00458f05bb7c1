"""Glob patterns: translated to anchored regular expressions on the driver, matched on the executors."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _class(p: str, i: int) -> tuple[str, int]:
    """The character class that begins at p[i] == '['; raises ValueError where it is malformed."""
    j, neg = i + 1, False
    if j < len(p) and p[j] in "^!":
        neg, j = True, j + 1
    body, first = "", True
    while True:
        if j >= len(p):
            raise ValueError("class not closed")
        if p[j] == "]" and not first:
            break
        ends = []
        for _ in range(2):
            if j >= len(p) or p[j] == "-" or (p[j] == "]" and not ends and not first):
                raise ValueError("bad class")
            if p[j] == "\\":
                j += 1
            if j >= len(p):
                raise ValueError("bad class")
            ends.append(p[j])
            j += 1
            if len(ends) == 1 and (j >= len(p) or p[j] != "-"):
                break
            if len(ends) == 1:
                j += 1
        first = False
        body += "-".join("\\" + c if not c.isalnum() else c for c in ends)
    return f"[{'^/' if neg else ''}{body}]", j + 1


def _part(p: str, braces: bool) -> str:
    """One pattern without ``**``."""
    out, i, depth = "", 0, 0
    while i < len(p):
        c = p[i]
        if c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            s, i = _class(p, i)
            out += s
        elif c == "\\":
            if i + 1 >= len(p):
                raise ValueError("escape at the end")
            out, i = out + re.escape(p[i + 1]), i + 2
        elif braces and c == "{":
            out, i, depth = out + "(?:", i + 1, depth + 1
        elif braces and c == "}" and depth:
            out, i, depth = out + ")", i + 1, depth - 1
        elif braces and c == "," and depth:
            out, i = out + "|", i + 1
        else:
            out, i = out + re.escape(c), i + 1
    if depth:
        raise ValueError("brace not closed")
    return out


def to_regex(pattern: str) -> str | None:
    """An anchored regular expression; None for a malformed pattern. With ``**`` in it, a whole part ``**`` stands for any
    number of parts (none too), and ``{a,b}`` for either; without, only ``* ? [..]`` and escapes, none crossing ``/``."""
    try:
        if "**" not in pattern:
            return f"^{_part(pattern, False)}$"
        parts = pattern.split("/")
        out, glue = "", ""
        for k, part in enumerate(parts):
            last = k == len(parts) - 1
            if part != "**":
                out, glue = out + glue + _part(part.replace("**", "*"), True), "/"
            elif k == 0:
                out, glue = out + (".*" if last else "(?:[^/]*/)*"), "" if not last else glue
            elif last:
                out += "(?:/.*)?" if glue else ".*"
            else:
                out += f"(?:{glue}[^/]*)*"
        return f"^{out}$"
    except ValueError:
        return None


@dataclass(frozen=True)
class Pattern:
    glob: str
    inverse: bool = False


def matches(value: Column, p: Pattern) -> Column:
    """A malformed pattern matches nothing, inverse or not."""
    regex = to_regex(p.glob)
    if regex is None:
        return F.lit(False)
    hit = value.rlike(regex)
    return ~hit if p.inverse else hit


def matches_list(value: Column, patterns: list[Pattern]) -> Column:
    """Order matters: the first plain hit is true, the first inverse miss is false, inverse hits alone are true at the end.
    No patterns: true."""

    def rest(i: int, seen: bool) -> Column:
        if i == len(patterns):
            return F.lit(seen)
        p = patterns[i]
        cond = F.coalesce(matches(value, p), F.lit(False))
        return F.when(cond, rest(i + 1, True)).otherwise(F.lit(False)) if p.inverse else F.when(cond, F.lit(True)).otherwise(rest(i + 1, seen))

    return rest(0, False) if patterns else F.lit(True)


def matches_groups(groups: Column, patterns: list[Pattern]) -> Column:
    """The same walk over groups (outer) and patterns (inner); no groups: false where there are patterns.
    States of the fold: 0 open, 1 open with an inverse hit, 2 true, 3 false."""
    if not patterns:
        return F.lit(True)

    def step(state, g):
        for p in patterns:
            cond = F.coalesce(matches(g, p), F.lit(False))
            moved = F.when(cond, F.lit(1)).otherwise(F.lit(3)) if p.inverse else F.when(cond, F.lit(2)).otherwise(state)
            state = F.when(state >= 2, state).otherwise(moved)
        return state

    return F.aggregate(F.coalesce(groups, F.array().cast("array<string>")), F.lit(0), step).isin(1, 2)


def search_name(name: Column, query: str) -> Column:
    """File search: a glob on the name where the query has ``*`` or ``?`` (and is well formed), else a substring, any case."""
    regex = to_regex(query.replace("**", "*")) if "*" in query or "?" in query else None
    return name.rlike(regex) if regex else F.contains(F.lower(name), F.lit(query.lower()))
