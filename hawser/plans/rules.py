"""Event rules: conditions compiled to predicates, rules matched to events, actions planned and ordered."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.glob import Pattern, matches_groups, matches_list

#: Triggers, and the file-system events that carry a size.
FS, PROVIDER, SCHEDULE, IP_BLOCKED, CERTIFICATE, ON_DEMAND, IDP_LOGIN = range(1, 8)
SIZED_EVENTS = ["upload", "pre-upload", "first-upload", "download", "pre-download", "first-download", "delete", "copy"]
#: Protocol of events that come from actions themselves: they trigger nothing.
ACTION_PROTOCOL = "EventAction"


@dataclass
class Conditions:
    events: list[str] = field(default_factory=list)
    names: list[Pattern] = field(default_factory=list)
    roles: list[Pattern] = field(default_factory=list)
    groups: list[Pattern] = field(default_factory=list)
    paths: list[Pattern] = field(default_factory=list)
    objects: list[str] = field(default_factory=list)
    protocols: list[str] = field(default_factory=list)
    statuses: list[int] = field(default_factory=list)
    min_size: int = 0
    max_size: int = 0
    idp_event: int = 0

    def __post_init__(self):
        if self.max_size and self.min_size and self.max_size <= self.min_size:
            raise ValueError("max_size must exceed min_size")
        if set(self.statuses) - {0, 1, 2, 3}:
            raise ValueError("unknown status")


@dataclass
class Action:
    name: str
    order: int
    is_failure_action: bool = False
    stop_on_failure: bool = False
    execute_sync: bool = False


@dataclass
class Rule:
    name: str
    trigger: int
    conditions: Conditions = field(default_factory=Conditions)
    actions: list[Action] = field(default_factory=list)
    status: int = 1


def predicate(rule: Rule, columns: list[str]) -> Column:
    """The rule as a condition over event columns (action, username, role, groups, virtual_path, virtual_target_path, protocol,
    file_size, object_type, idp_event). A column the events lack is empty."""
    c = rule.conditions
    empty = {"file_size": F.lit(0), "groups": F.array().cast("array<string>")}
    col = lambda k: F.col(k) if k in columns else empty.get(k, F.lit(""))
    if rule.trigger in (IP_BLOCKED, CERTIFICATE, SCHEDULE, ON_DEMAND):
        return F.lit(True)
    out = F.lit(True)
    if c.names:
        out &= matches_list(col("username"), c.names)
    if rule.trigger == IDP_LOGIN:
        return out & ((col("idp_event") == c.idp_event) if c.idp_event else F.lit(True))
    out &= F.col("action").isin(c.events)
    if c.roles:
        out &= matches_list(col("role"), c.roles)
    if c.groups:
        out &= matches_groups(col("groups"), c.groups)
    if rule.trigger == PROVIDER:
        return out & (col("object_type").isin(c.objects) if c.objects else F.lit(True))
    if c.paths:
        out &= matches_list(col("virtual_path"), c.paths)
    if c.protocols:
        out &= col("protocol").isin(c.protocols)
    sized = F.col("action").isin(SIZED_EVENTS)
    if c.min_size:
        out &= ~sized | (col("file_size") >= c.min_size)
    if c.max_size:
        out &= ~sized | (col("file_size") <= c.max_size)
    return out


def match(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Each event once for each active rule it triggers (column rule). One pass: a compiled condition for each rule. Events that
    actions caused trigger nothing."""
    live = [r for r in rules if r.status == 1]
    fresh = events.where(F.col("protocol") != ACTION_PROTOCOL) if "protocol" in events.columns else events
    hits = F.array_compact(F.array(*[F.when(predicate(r, events.columns), F.lit(r.name)) for r in live])) if live else F.array().cast("array<string>")
    return fresh.withColumn("rule", F.explode(hits))


def plan_actions(matched: DataFrame, rules: list[Rule]) -> DataFrame:
    """The actions of every match, in order (columns action_name, position, sync, failure_action), gated by event status."""
    t = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.array(*[F.struct(F.lit(a.order).alias("position"), F.lit(a.name).alias("action_name"), F.lit(a.execute_sync).alias("sync"), F.lit(a.is_failure_action).alias("failure_action"), F.lit(a.stop_on_failure).alias("stop")) for a in sorted(r.actions, key=lambda a: a.order)]))])
    gate = F.lit(True)
    if "status" in matched.columns:
        for r in rules:
            if r.conditions.statuses:
                gate &= (F.col("rule") != r.name) | F.col("status").isin(r.conditions.statuses)
    return matched.where(gate).withColumn("__a", F.explode(t[F.col("rule")])).select(*matched.columns, "__a.*")


def run_order(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Which planned actions run, given whether each would succeed (column ok): synchronous ones in order, then the others in
    order, then, if any of these failed, the failure actions; one that fails and stops ends its own series only."""
    item = F.struct("position", "failure_action", "sync", "stop", "ok", "action_name")
    plan = outcomes.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("acts"))
    zero = F.struct(F.lit(False).alias("stopped"), F.lit(False).alias("failed"), F.array().cast("array<string>").alias("ran"))

    def one(s, a):
        bad = ~s["stopped"] & ~a["ok"]
        return F.struct((s["stopped"] | (bad & a["stop"])).alias("stopped"), (s["failed"] | bad).alias("failed"), F.when(s["stopped"], s["ran"]).otherwise(F.concat(s["ran"], F.array(a["action_name"]))).alias("ran"))

    series = lambda test: F.aggregate(F.filter("acts", test), zero, one)
    plan = plan.withColumn("s", series(lambda a: ~a["failure_action"] & a["sync"])).withColumn("a", series(lambda a: ~a["failure_action"] & ~a["sync"]))
    plan = plan.withColumn("late", series(lambda a: a["failure_action"])["ran"]).withColumn("failed", F.col("s.failed") | F.col("a.failed"))
    ran = F.concat(F.col("s.ran"), F.col("a.ran"), F.when(F.col("failed"), F.col("late")).otherwise(F.array().cast("array<string>")))
    return plan.select(*by, ran.alias("ran"), F.when(F.col("failed"), 2).otherwise(1).alias("status"))
