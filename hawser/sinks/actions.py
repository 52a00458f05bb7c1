"""Actions of event rules, rendered as rows: what to request, run, send or do. Delivery stays with the caller, in parallel.

Each function takes a frame of planned actions over events and one action's configuration; the templates' tokens are those of
``text.event_tokens``. Rows are never collected; a ``deliver`` function sees a partition at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text

#: Statuses of an HTTP answer that count as delivered.
OK_FROM, OK_TO = 200, 204


def _render(events: DataFrame, source: str, escape=None) -> Column:
    return text.template(source, text.event_tokens(events.columns), escape, text.RAW_TOKENS)


def _texts(events: DataFrame, sources: list[str]) -> Column:
    return F.array(*[_render(events, s) for s in sources]) if sources else F.array().cast("array<string>")


def _pairs(events: DataFrame, values: dict[str, str]) -> Column:
    """A map of the rendered values; keys are taken as they are."""
    cells = [x for k, v in values.items() for x in (F.lit(k), _render(events, v))]
    return F.create_map(*cells) if cells else F.create_map().cast("map<string,string>")


def http_requests(events: DataFrame, endpoint: str, method: str = "POST", body: str = "", headers: dict[str, str] | None = None, query: dict[str, str] | None = None) -> DataFrame:
    """The events with method, url (query values escaped), headers and body of the request that each of them causes."""
    url = _render(events, endpoint)
    for i, (k, v) in enumerate(sorted((query or {}).items())):
        joint = F.when(F.contains(url, F.lit("?")), "&").otherwise("?") if i == 0 else F.lit("&")
        url = F.concat(url, joint, text.url_query_escaped(F.lit(k)), F.lit("="), text.url_query_escaped(_render(events, v)))
    return events.select("*", F.lit(method).alias("request_method"), url.alias("request_url"), _pairs(events, headers or {}).alias("request_headers"), (_render(events, body) if body and method != "GET" else F.lit(None).cast("string")).alias("request_body"))


def commands(events: DataFrame, command: str, allowed: list[str], args: list[str] | None = None, env: dict[str, str] | None = None) -> DataFrame:
    """The events with the command line that each causes and its whole environment; a command that is not allowed is an error."""
    if command not in allowed:
        raise ValueError(f"command {command!r} is not allowed")
    return events.select("*", F.lit(command).alias("command"), _texts(events, args or []).alias("command_args"), _pairs(events, env or {}).alias("command_env"))


def mails(events: DataFrame, recipients: list[str], subject: str, body: str, bcc: list[str] | None = None, html: bool = False) -> DataFrame:
    """The events with the message that each causes; values are escaped in HTML bodies. Recipients that are a list of addresses
    (comma-separated) are split, empty ones go."""
    split = lambda sources: F.filter(F.transform(F.flatten(F.transform(_texts(events, sources), lambda s: F.split(s, ","))), lambda s: F.trim(s)), lambda s: s != "")
    return events.select("*", split(recipients).alias("mail_to"), split(bcc or []).alias("mail_bcc"), _render(events, subject).alias("mail_subject"), _render(events, body, text.html_escaped if html else None).alias("mail_body"))


def file_operations(events: DataFrame, kind: str, items: list[str] | dict[str, str]) -> DataFrame:
    """The events, a row for each path that an action deletes, makes or looks for, or each source and target that it renames or
    copies, with clean paths, in order. kind: delete, mkdir, exist, rename, copy or compress."""
    pairs = list(items.items()) if isinstance(items, dict) else [(i, None) for i in items]
    clean = lambda s: paths.clean(_render(events, s)) if s is not None else F.lit(None).cast("string")
    rows = F.array(*[F.struct(F.lit(n).alias("position"), F.lit(kind).alias("operation"), clean(a).alias("source"), clean(b).alias("target")) for n, (a, b) in enumerate(pairs)])
    return events.withColumn("__op", F.explode(rows)).select(*events.columns, "__op.*")


def delivered(requests: DataFrame, key: str, send: Callable[[Iterable[dict]], Iterable[int]]) -> DataFrame:
    """key and ok of every row, sent from the executors: ``send`` takes the rows of a batch as dicts and returns an answer code
    for each (HTTP status; for other kinds any of 200 to 204 for success). Tasks may run again, so it should bear repeats."""
    kind = requests.schema[key].dataType.simpleString()

    def run(frames):
        for f in frames:
            codes = list(send(f.to_dict("records")))
            yield f[[key]].assign(ok=[OK_FROM <= c <= OK_TO for c in codes])

    return requests.mapInPandas(run, f"`{key}` {kind}, ok boolean")
