"""Tables in, durable intermediate tables, and the held-out folds. Paths go through Spark only."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..ship import ship
from ._vec import blocks


BATCH_BYTES = 4 << 20

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one of ours only where it is unset (local tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        app = spark.sparkContext.applicationId
        at = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="hawser-"))
    return at.rstrip("/")


def durable(df: DataFrame, tag: str) -> DataFrame:
    """The frame written once as a table in the shared folder and read back: its lineage ends there, a lost
    executor costs no recomputation, and readers still prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hawser/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> bool:
    """Deletes all intermediate tables of this library in the shared folder; frames that read them are of no use then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/hawser")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key is fold 0."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus)).cast("int"), F.lit(0))


def sample_rate(total: int, bound: int) -> float:
    return min(1.0, bound / max(total, 1))


def chosen(key: Column, rate: float, seed: int = 7) -> Column:
    """A repeatable choice of rows at the rate given: by a hash of the key, not by position."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(1_000_000)) < F.lit(int(round(rate * 1_000_000)))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES to Python: they bound what a task holds, on either side of the pipe."""
    if int(str(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_blocks(df: DataFrame, keep: dict[str, Column], text: Column, fn, fields: list[T.StructField]) -> DataFrame:
    """``keep`` columns plus what ``fn(Block) -> list of arrays`` computes of the texts, a block at a time.

    One narrow stage; memory is bounded by an Arrow batch and one block of ``_vec.BLOCK_BYTES``. Only the columns
    named are read, so further columns of the table, whatever their names, neither travel nor clash.
    """
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    src = df.select(*[c.alias(k) for k, c in keep.items()], text.cast("string").alias("__text"))
    names, kept = [f.name for f in fields], list(keep)
    schema = T.StructType([*[src.schema[k] for k in kept], *fields])

    def run(batches):
        target = to_arrow_schema(T.StructType(fields))
        for rb in batches:
            parts = [[pa.array(x, target.field(i).type) for i, x in enumerate(fn(b))] for _, b in blocks(rb.column(len(kept)))]
            if parts:
                new = [pa.concat_arrays(list(c)) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([*(rb.column(i) for i in range(len(kept))), *new], names=[*kept, *names])

    return src.mapInArrow(run, schema)
