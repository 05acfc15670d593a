"""Sources and sinks: reading raw relations, binding names, batches, feeds, increments and views."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Contract types and what they are on disk; any other type stays text and is reported.
PHYSICAL = {"string": "string", "integer": "bigint", "number": "decimal(38,9)", "boolean": "boolean", "date": "date", "date-time": "timestamp"}


#: Hash keys are hexadecimal, so entropy coding halves what tables of them take.
PACKED = "zstd"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the one of ``spark.checkpoint.dir``, which all executors share; without
    that setting below the warehouse, but only on a single machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_keelvault"
    return f"{top.rstrip('/')}/vault-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in a shared folder: made once, and a lost executor costs a re-read only."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.option("compression", PACKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_source(spark: SparkSession, path: str, types: Mapping[str, str], fmt: str = "parquet") -> tuple[DataFrame, list[str]]:
    """A raw relation with pinned column types, and the columns whose type is unknown (left as text).

    Values that don't fit their type become null. Only the named columns are read."""
    if fmt == "csv":
        raw = spark.read.schema(StructType([StructField(c, StringType()) for c in types])).option("header", True).csv(path)
    else:
        raw = spark.read.format(fmt).load(path).select(*types)
    unknown = [c for c, t in types.items() if t not in PHYSICAL]
    typed = [(F.col(c).cast("string") if c in unknown else F.col(c).try_cast(PHYSICAL[t])).alias(c) for c, t in types.items()]
    return raw.select(*typed), unknown


def bind(df: DataFrame, mapping: Mapping[str, str], override: Mapping[str, str] | None = None) -> DataFrame:
    """Physical columns under canonical names ({canonical: physical}); an override wins over the mapping."""
    chosen = {**mapping, **(override or {})}
    return df.select(*[F.col(physical).alias(name) for name, physical in chosen.items()])


def snapshot_batch(df: DataFrame, load_dts=None, column: str = "LOAD_DATETIME") -> DataFrame:
    """The rows of one load batch; all rows when no batch is named. The filter reaches the scan."""
    return df if load_dts is None else df.where(F.col(column) == F.lit(load_dts))


#: The partition column of tables that are laid out by load date.
LOAD_DATE = "LOAD_DATE"


def append_by_date(rows: DataFrame, path: str, column: str = "LOAD_DATETIME") -> None:
    """Append rows to a table that has a folder a load date, so that readers of a batch open no other."""
    dated = rows.withColumn(LOAD_DATE, F.to_date(column))
    dated.repartition(LOAD_DATE).write.mode("append").partitionBy(LOAD_DATE).parquet(path)


def read_batch(spark: SparkSession, path: str, load_dts=None, since=None, column: str = "LOAD_DATETIME") -> DataFrame:
    """Rows of a table that is laid out by load date: those of one load time, those from a load time on
    (what may be late for a target is never older than its own oldest open batch), or all."""
    df = spark.read.parquet(path)
    for value, of in ((load_dts, lambda c, v: c == v), (since, lambda c, v: c >= v)):
        if value is not None:
            at = F.lit(value).cast("timestamp")
            df = df.where(of(F.col(LOAD_DATE), at.cast("date")) & of(F.col(column), at))
    return df.drop(LOAD_DATE)


def union_feeds(frames: Sequence[DataFrame]) -> DataFrame:
    """The stages of all feeds of one hub, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def append_increment(rows: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append the rows whose keys are not stored at ``path`` yet; a repeated run appends nothing.

    Keys may be null. Equal keys within ``rows`` are all appended: loaders give one row a key."""
    spark = rows.sparkSession
    try:
        stored = spark.read.schema(rows.schema).parquet(path).select(*[F.col(k).alias(f"_kv_{k}") for k in keys])
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = None
    if stored is not None:
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_kv_{k}")) for k in keys])
        rows = rows.join(stored, same, "left_anti")
    rows.write.mode("append").parquet(path)


def stage_view(df: DataFrame, name: str) -> DataFrame:
    """Publish a stage as a view: readers share its plan, nothing is stored."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)
