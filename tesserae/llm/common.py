"""Shared helpers of the corpus operators: paths, stored intermediates, and small Column idioms."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of anything but ASCII white space (fixed by the operators' contracts).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir, which all its machines see; without one there is nowhere to
    put what must outlive an executor. A session on one machine (tests, benches) gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        where = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def stored(df: DataFrame, **options: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def places(rows: DataFrame, groups: list[str], tie: str, weight: Column | None = None) -> DataFrame:
    """`rows` with long `_at`: the weights (each 1 if not given) of the rows of its group before it in the order of `tie`.

    rows: stored, with `_uid` by monotonically_increasing_id; rows of one tie have one weight, and which of them comes
    first is open, as they are equal. No window holds the rows of a tie at once: they are counted for each partition
    they were stored from, and numbered inside it. Groups are the caller's and must be of bounded size, ties counted
    once for each partition."""
    weight = F.lit(1) if weight is None else weight
    rows = rows.withColumn("_pid", F.shiftright("_uid", 33)).withColumn("_weight", weight.cast("long"))
    keys = [*groups, tie, "_pid"]
    counted = rows.groupBy(*keys).agg(F.sum("_weight").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*groups).orderBy(tie, "_pid").rowsBetween(Window.unboundedPreceding, -1))
    counted = counted.select(F.struct(*keys).alias("_key"), F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_key").orderBy("_uid")) - 1
    out = rows.withColumn("_key", F.struct(*keys)).withColumn("_number", number.cast("long")).join(counted, "_key")
    return out.withColumn("_at", F.col("_before") + F.col("_number") * F.col("_weight")).drop("_key", "_before", "_number", "_pid", "_weight")


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Limits Arrow batches by bytes, so that long texts do not swell a Python worker (rows alone are the default)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def let(value: Column, body) -> Column:
    """`body(v)` with `v` bound once to `value`, so that a lambda inside `body` does not evaluate it again per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)
