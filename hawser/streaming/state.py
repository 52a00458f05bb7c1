"""Stateful operators: pure folds over a key's ordered events, run in batch by applyInPandas and over streams by
applyInPandasWithState (state survives in the checkpoint and times out)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.aggregates import SCORES
from ..ship import ship

MIN_US = 60_000_000


@dataclass(frozen=True)
class Defender:
    """Abuse detector. ``stored``: the variant that keeps events on a ban and bans above the threshold only; otherwise a
    ban needs a second event and a total of at least the threshold, and clears the host's events."""

    threshold: int = 15
    observation_min: int = 30
    ban_min: int = 30
    ban_increment: int = 50
    stored: bool = False

    def extension_us(self) -> int:
        return max(1, self.ban_min * self.ban_increment // 100) * MIN_US

    def step(self, state: dict, ts: int, score: int) -> dict:
        """One event of a host. state: events (list of (ts, score)), until. Returns the new state, with ``total`` and ``banned``
        (a new ban). Events during a ban are ignored; an event without a score makes a host known."""
        events, until = list(state.get("events", [])), state.get("until", 0)
        if until > ts:
            return {"events": events, "until": until, "total": 0, "banned": False}
        edge = ts - self.observation_min * MIN_US
        had = bool(events)
        events = [e for e in events if e[0] > edge or (self.stored and e[0] == edge)]
        if score > 0 or not self.stored:
            events.append((ts, score))
        total = sum(s for _, s in events)
        ban = score > 0 and total > self.threshold if self.stored else had and total >= self.threshold
        if ban:
            return {"events": events if self.stored else [], "until": ts + self.ban_min * MIN_US, "total": total, "banned": True}
        return {"events": events, "until": 0, "total": total, "banned": False}


    def check(self, state: dict, ts: int) -> dict:
        """Whether a host that connects is banned (``banned`` tells a new ban, so it is False here); a running ban is extended."""
        until = state.get("until", 0)
        return {"events": list(state.get("events", [])), "until": until + self.extension_us() if until > ts else until, "total": 0, "banned": False}


#: The event of a host that connects: its ban, if there is one, is checked and extended.
CHECK = "Check"
_DEFENDER_OUT = "ip string, id long, ts_us long, score int, total long, banned boolean, banned_until_us long"


def _score(event: str) -> int:
    return SCORES.get(event, 0)


def _replay(d: Defender, state: dict, f: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
    out = []
    for ip, i, ts, event in zip(f.ip, f.id, f.ts_us, f.event, strict=True):
        s = _score(event)
        state = d.check(state, int(ts)) if event == CHECK else d.step(state, int(ts), s)
        out.append((ip, i, ts, s, state["total"], state["banned"], state["until"]))
    return state, pd.DataFrame(out, columns=["ip", "id", "ts_us", "score", "total", "banned", "banned_until_us"])


def defend(events: DataFrame, d: Defender = Defender()) -> DataFrame:
    """Every event with its host's total, new bans and the end of a running one. events: ip, id, ts_us, event."""

    ship(events.sparkSession)

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        return _replay(d, {}, f.sort_values(["ts_us", "id"]))[1]

    return events.select("ip", "id", "ts_us", "event").groupBy("ip").applyInPandas(fold, _DEFENDER_OUT)


def defend_stream(events: DataFrame, d: Defender = Defender()) -> DataFrame:
    """The same over a stream; a host's state goes once it has been quiet for the observation time and any ban is over."""
    ship(events.sparkSession)

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["ts_us", "id"])
        now, out = _replay(d, now, rows)
        state.update((json.dumps({"events": now["events"], "until": now["until"]}),))
        left_us = max(now["until"] - int(rows.ts_us.max()), 0)
        state.setTimeoutDuration(d.observation_min * 60_000 + max(left_us // 1000, d.ban_min * 60_000))
        yield out

    return events.select("ip", "id", "ts_us", "event").groupBy("ip").applyInPandasWithState(update, _DEFENDER_OUT, "state string", "append", "ProcessingTimeTimeout")


@dataclass(frozen=True)
class RateLimit:
    """Token bucket: average events a period (ms), burst. A reservation that would wait longer than max_delay is given back."""

    average: int
    period_ms: int = 1000
    burst: int = 1

    @property
    def rate(self) -> float:
        return self.average * 1000.0 / self.period_ms

    @property
    def max_delay_us(self) -> float:
        delay = self.period_ms * 500.0 if self.rate < 1 else 1e6 / (2 * int(self.rate))
        return min(delay, 10e6)

    def step(self, state: tuple[float, int], ts: int) -> tuple[tuple[float, int], bool, float]:
        """state: tokens, last time. Returns the state, whether the event passes, and its delay in microseconds."""
        if self.burst <= 0:
            return state, False, 0.0
        tokens, last = state
        tokens = min(float(self.burst), tokens + max(0, ts - last) * self.rate / 1e6) - 1
        delay = 0.0 if tokens >= 0 else -tokens / self.rate * 1e6
        if delay > self.max_delay_us:
            return (tokens + 1, ts), False, delay
        return (tokens, ts), True, delay


_LIMIT_OUT = "key string, id long, ts_us long, passed boolean, delay_us double"


def limit_rate(events: DataFrame, r: RateLimit) -> DataFrame:
    """Which events pass, by key. events: key, id, ts_us."""

    ship(events.sparkSession)

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["ts_us", "id"])
        state, out = (float(r.burst), int(f.ts_us.iloc[0])), []
        for ts in f.ts_us.tolist():
            state, ok, delay = r.step(state, ts)
            out.append((ok, delay))
        return f.assign(passed=[o[0] for o in out], delay_us=[o[1] for o in out])[["key", "id", "ts_us", "passed", "delay_us"]]

    return events.select("key", "id", "ts_us").groupBy("key").applyInPandas(fold, _LIMIT_OUT)


def limit_rate_stream(events: DataFrame, r: RateLimit) -> DataFrame:
    ship(events.sparkSession)

    def update(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts_us", "id"])
        now, out = (tuple(state.get) if state.exists else (float(r.burst), int(rows.ts_us.iloc[0]))), []
        for ts in rows.ts_us.tolist():
            now, ok, delay = r.step(now, ts)
            out.append((ok, delay))
        state.update(now)
        state.setTimeoutDuration(max(1000, int(r.burst / r.rate * 1000) + 1000))
        yield rows.assign(passed=[o[0] for o in out], delay_us=[o[1] for o in out])[["key", "id", "ts_us", "passed", "delay_us"]]

    return events.select("key", "id", "ts_us").groupBy("key").applyInPandasWithState(update, _LIMIT_OUT, "tokens double, last long", "append", "ProcessingTimeTimeout")


def match_stream(events: DataFrame, load_rules, deliver, checkpoint: str):
    """Rules over a stream: read again for every micro-batch, matched, and their planned actions handed to deliver(df, epoch)."""
    from ..plans.rules import match, plan_actions

    def run(batch: DataFrame, epoch: int) -> None:
        rules = load_rules()
        deliver(plan_actions(match(batch, rules), rules), epoch)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def quota_stream(deltas: DataFrame, store, checkpoint: str):
    """Quota deltas folded once a micro-batch; store(df, epoch) adds the net changes."""
    from ..operators.aggregates import coalesce_deltas

    def run(batch: DataFrame, epoch: int) -> None:
        store(coalesce_deltas(batch), epoch)

    return deltas.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def windowed_counters(events: DataFrame, every: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Extension: transfer counters by event-time window with a watermark, for endless streams. events: ts (timestamp), action, file_size."""
    from pyspark.sql import functions as F

    w = events.withWatermark("ts", late).groupBy(F.window("ts", every), "action")
    return w.agg(F.count("*").alias("events"), F.sum("file_size").alias("bytes")).select(F.col("window.start").alias("start"), "action", "events", "bytes")
