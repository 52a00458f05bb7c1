"""Sinks: CSV and JSON exports, dumps, reports and streaming notifiers. Written by Spark's committers, in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_safe


def csv(df: DataFrame, path: str, guard: bool = True) -> None:
    """CSV with a header; text cells guarded against formula injection."""
    kinds = dict(df.dtypes)
    cols = [csv_safe(F.col(c)).alias(c) if guard and kinds[c] == "string" else F.col(c) for c in df.columns]
    df.select(*cols).write.option("header", True).csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def json_array(df: DataFrame, chunk: int = 500):
    """The rows as the text of one JSON array, a chunk of rows at a time; the driver holds one partition at most."""
    part, first = [], True
    yield "["
    for row in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        part.append(row["j"])
        if len(part) == chunk:
            yield ("" if first else ",") + ",".join(part)
            part, first = [], False
    if part:
        yield ("" if first else ",") + ",".join(part)
    yield "]"


def retention_report(report: DataFrame, path: str) -> None:
    """One compressed CSV folder for each user."""
    report.write.partitionBy("username").option("header", True).option("compression", "gzip").csv(path)


def dump(entities: dict[str, DataFrame], path: str, scopes: list[str] | None = None) -> None:
    """A JSON dataset for each entity, or for those in scope."""
    for name, df in entities.items():
        if not scopes or name in scopes:
            df.write.json(f"{path}/{name}")


def metrics(counters: DataFrame, key: str) -> DataFrame:
    """Counters in the text format that scrapers read: name, labels, value."""
    values = [c for c in counters.columns if c != key]
    stack = ", ".join(f"'{c}', `{c}`" for c in values)
    rows = counters.selectExpr(f"`{key}` AS label", f"stack({len(values)}, {stack}) AS (name, value)")
    return rows.select(F.format_string(f'%s{{{key}="%s"}} %d', "name", "label", "value").alias("line"))


def notifier(deliver, retry_max_s: int, queue_max: int):
    """foreachBatch function: delivers a batch; rows that failed earlier are retried until they are too old or too many.
    deliver(df) returns the rows that were not delivered. Rows carry timestamp (ns)."""
    queue: dict[str, DataFrame] = {}

    def run(batch: DataFrame, epoch: int) -> None:
        todo = batch.unionByName(queue.pop("rows")) if "rows" in queue else batch
        failed = deliver(todo)
        if failed is None or retry_max_s <= 0:
            return
        young = failed.where((F.unix_micros(F.current_timestamp()) * 1000 - F.col("timestamp")) <= retry_max_s * 1_000_000_000)
        queue["rows"] = young.orderBy("timestamp").limit(queue_max).checkpoint()

    return run
