"""Plans around accounts and transfers: what a closed transfer leaves behind, accounts from a login template, task runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dml


def closed_transfers(transfers: DataFrame, now_ns: Column | int) -> tuple[DataFrame, DataFrame]:
    """Events and quota deltas of transfers that ended. transfers: id, username, path, kind, bytes, old_size, error (text),
    quota_exceeded. Failed uploads count what they left; downloads move no disk quota."""
    status = F.when(F.col("quota_exceeded"), 3).when(F.col("error") != "", 2).otherwise(1)
    events = transfers.select("id", F.lit(now_ns).alias("timestamp") if isinstance(now_ns, int) else now_ns.alias("timestamp"), F.col("kind").alias("action"), "username", F.col("path").alias("virtual_path"), F.col("bytes").alias("file_size"), status.alias("status"))
    up = transfers.where(F.col("kind") == "upload")
    deltas = up.groupBy(F.col("username").alias("key")).agg(F.count_if(F.col("old_size") == 0).alias("files"), F.sum(F.col("bytes") - F.col("old_size")).cast("long").alias("size"))
    return events, deltas.where("files <> 0 OR size <> 0")


def accounts_from_login(logins: DataFrame, users: DataFrame, template: str, schema: str, mode: int) -> DataFrame:
    """Users after a check at login: the template, its placeholders JSON-escaped, makes the account; mode 1 never changes an
    existing one. logins: name and the template's values; schema: of the parsed template, with username."""
    body = text.template(template, {c: F.col(c) for c in logins.columns}, escape=text.json_escaped)
    made = logins.select(F.from_json(body, schema).alias("u")).select("u.*").where("username is not null").dropDuplicates(["username"])
    return dml.restore(users, made, ["username"], 1 if mode == 1 else 0)[0]


def admins_from_login(logins: DataFrame, admins: DataFrame, template: str, schema: str, mode: int, kept: tuple[str, ...] = ("totp_config", "recovery_codes")) -> DataFrame:
    """The same for administrators. An existing one keeps its password if the template has none, and its columns in ``kept``."""
    out = accounts_from_login(logins, admins, template, schema, mode)
    own = ["password", *[c for c in kept if c in admins.columns]]
    out = out.join(admins.select("username", *[F.col(c).alias(f"__{c}") for c in own], F.lit(True).alias("__old")), "username", "left")
    new = {c: F.when(F.col("__old"), F.col(f"__{c}")).otherwise(F.col(c)) for c in own[1:]}
    new["password"] = F.when(F.coalesce("password", F.lit("")) != "", F.col("password")).otherwise(F.coalesce("__password", F.uuid()))
    return out.withColumns(new).select(*admins.columns)


def runnable(tasks: DataFrame, now_ms: int, lock_ms: int = 600_000) -> DataFrame:
    """Tasks that may start: not touched by another run's heartbeat lately."""
    return tasks.where(F.col("updated_at") + lock_ms < now_ms)
