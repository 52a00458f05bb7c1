"""Event search, scans, paging and export."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Page sizes.
PAGE_DEFAULT, PAGE_CAP, EVENTS_DEFAULT, EVENTS_CAP = 100, 500, 100, 1000


def split_param(value: str) -> list[str]:
    """Comma-separated list: trimmed, empties dropped, first of equals kept."""
    return list(dict.fromkeys(x for x in (p.strip() for p in value.split(",")) if x))


def int_params(value: str, allowed: set[int], strict: bool) -> list[int]:
    """Numbers of a list parameter; what cannot be read is skipped, or an error where strict."""
    out = []
    for x in split_param(value):
        try:
            n = int(x)
        except ValueError:
            n = None
        if n is None or (strict and n not in allowed):
            if strict:
                raise ValueError(f"invalid value {x!r}")
            continue
        out.append(n)
    return out


@dataclass
class EventFilter:
    """A conjunctive filter; 0, "", [] and fs_provider -1 mean any. Both ends of the time range are inclusive."""

    start: int = 0
    end: int = 0
    equal: dict[str, str] = field(default_factory=dict)
    among: dict[str, list] = field(default_factory=dict)
    fs_provider: int = -1
    role: str = ""
    order: str = "DESC"
    limit: int = EVENTS_DEFAULT
    from_id: str = ""

    def scoped(self, admin_role: str) -> EventFilter:
        """An admin's role overrides the role asked for."""
        return EventFilter(**{**self.__dict__, "role": admin_role or self.role})

    def condition(self) -> Column:
        c = F.lit(True)
        if self.start:
            c &= F.col("timestamp") >= self.start
        if self.end:
            c &= F.col("timestamp") <= self.end
        for k, v in self.equal.items():
            if v:
                c &= F.col(k) == v
        for k, v in self.among.items():
            if v:
                c &= F.col(k).isin(v)
        if self.fs_provider >= 0:
            c &= F.col("fs_provider") == self.fs_provider
        if self.role:
            c &= F.col("role") == self.role
        return c


def search_events(events: DataFrame, f: EventFilter) -> DataFrame:
    """A page of events by time, then id; with from_id, what comes after that event at the page's first time."""
    if not 1 <= f.limit <= EVENTS_CAP:
        raise ValueError(f"limit must be between 1 and {EVENTS_CAP}")
    if f.order not in ("ASC", "DESC"):
        raise ValueError("order must be ASC or DESC")
    rows, up = events.where(f.condition()), f.order == "ASC"
    if f.from_id:
        edge = f.start if up else f.end
        past = F.col("id") > int(f.from_id) if up else F.col("id") < int(f.from_id)
        rows = rows.where((F.col("timestamp") != edge) | past)
    keys = [F.col("timestamp"), F.col("id")]
    return rows.orderBy(*[k.asc() if up else k.desc() for k in keys]).limit(f.limit)


def _arrow(first: str, second: str) -> Column:
    return F.when(F.col(second) != "", F.concat(first, F.lit(" => "), second)).otherwise(F.col(first))


def _exported(events: DataFrame, cells: dict[str, Column]) -> DataFrame:
    return events.select("id", *[text.csv_safe(F.coalesce(c.cast("string"), F.lit(""))).alias(k) for k, c in cells.items()])


def fs_export(events: DataFrame) -> DataFrame:
    """Rows of the file-system event export, with the event's id: readable, every cell safe to open in a spreadsheet. One scan,
    no paging."""
    return _exported(events, {
        "time": text.rfc3339_nano(F.col("timestamp")), "action": F.col("action"), "path": _arrow("virtual_path", "virtual_target_path"), "fs_path": _arrow("fs_path", "fs_target_path"),
        "size": F.when(F.col("file_size") > 0, text.size_iec(F.col("file_size"))), "elapsed": F.when(F.col("elapsed") > 0, text.go_duration(F.col("elapsed"))), "status": text.status_label(F.col("status")),
        "user": F.col("username"), "protocol": F.col("protocol"), "ip": F.col("ip"), "ssh_cmd": F.col("ssh_cmd"), "role": F.col("role"),
    })


def provider_export(events: DataFrame) -> DataFrame:
    """Rows of the export of changes to users, folders and other objects, with the event's id."""
    return _exported(events, {
        "time": text.rfc3339_nano(F.col("timestamp")), "action": F.col("action"), "object_type": F.col("object_type"), "object_name": F.col("object_name"),
        "user": F.col("username"), "ip": F.col("ip"), "role": F.col("role"),
    })


def log_export(events: DataFrame) -> DataFrame:
    """Rows of the export of log events (logins and negotiations), with the event's id."""
    return _exported(events, {
        "time": text.rfc3339_nano(F.col("timestamp")), "event": text.log_event_label(F.col("event")), "protocol": F.col("protocol"), "user": F.col("username"),
        "ip": F.col("ip"), "message": F.col("message"), "role": F.col("role"),
    })


def page(rows: DataFrame, key: str, limit: int = PAGE_DEFAULT, offset: int = 0, order: str = "ASC") -> DataFrame:
    """Sorted page; the limit is capped, an unknown order is an error. Filter before: the offset counts what is left."""
    if order not in ("ASC", "DESC"):
        raise ValueError("order must be ASC or DESC")
    if limit <= 0 or limit > PAGE_CAP:
        limit = PAGE_CAP if limit > PAGE_CAP else PAGE_DEFAULT
    return rows.orderBy(F.col(key).asc() if order == "ASC" else F.col(key).desc()).offset(max(offset, 0)).limit(limit)


def keyset(rows: DataFrame, key: str, after: str = "", prefix: str = "", limit: int = PAGE_DEFAULT, order: str = "ASC") -> DataFrame:
    """Page after a key, in text order."""
    if prefix:
        rows = rows.where(F.startswith(key, F.lit(prefix)))
    if after:
        rows = rows.where(F.col(key) > after if order == "ASC" else F.col(key) < after)
    return rows.orderBy(F.col(key).asc() if order == "ASC" else F.col(key).desc()).limit(limit)


def top_recent(rows: DataFrame, key: str, limit: int) -> DataFrame:
    return rows.orderBy(F.col(key).desc()).limit(limit)


def incremental(rows: DataFrame, since: int) -> DataFrame:
    """Changed since then, or deleted."""
    return rows.where((F.col("updated_at") >= since) | (F.col("deleted_at") > 0))


def fresher(rows: DataFrame, than: int) -> DataFrame:
    return rows.where(F.col("updated_at") > than)


def live(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("deleted_at") == 0)


def find_files(files: DataFrame, condition: Column, max_dirs: int = 5000, max_results: int = 2000) -> DataFrame:
    """Breadth-first search: among the first max_dirs directories by depth and path, the first max_results hits."""
    from ..functions import paths

    parent = paths.parent(F.col("path"))
    dirs = files.select(parent.alias("dir")).distinct().orderBy(paths.depth(F.col("dir")), "dir").limit(max_dirs)
    seen = files.withColumn("dir", parent).join(dirs, "dir", "left_semi")
    return seen.where(condition).orderBy(paths.depth(F.col("path")), "path").limit(max_results).select(*files.columns)
