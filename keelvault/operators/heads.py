"""Satellites with heads: beside each history a table of what counts now, so a batch reads no history.

A head table has the latest row of each key (of a multi-active satellite the mark of the latest set, of
an effectivity satellite the open relationships), laid out by buckets of the key. A batch reads and
rewrites the buckets that it touches. The history is written by batch, so a batch that is run again,
after a failure between the two writes or by mistake, writes the same rows in the same place, or none."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelvault.operators.load import _last_sets, _sets, high_date, load_eff_sat, load_ma_sat, load_sat
from keelvault.operators.stage import LDTS
from keelvault.sources.feeds import PACKED, shared_folder

BUCKET, BATCH, RUN = "_kv_bucket", "_kv_batch", "_kv_run"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a satellite, without the marks of batches."""
    return spark.read.parquet(f"{path}/rows").drop(BATCH, RUN)


def _touched(batch: DataFrame, path: str, key: Sequence[str], buckets: int) -> DataFrame | None:
    """The heads of the buckets that a batch touches, with their bucket; None before the first batch."""
    try:
        heads = batch.sparkSession.read.parquet(f"{path}/heads")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    touched = batch.select(F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).distinct().collect()  # at most all buckets
    return heads.where(F.col(BUCKET).isin([r[0] for r in touched]))


def _load(batch: DataFrame, path: str, batch_id: str, key: Sequence[str], buckets: int, load: Callable, heads_of: Callable, head: Callable = lambda rows: rows) -> DataFrame:
    """Load one batch: ``load(heads)`` gives its new rows, which go to the history and are read from there;
    ``head(new rows)`` what is kept of them, and ``heads_of(old heads and these)`` the new heads, within
    buckets. A key never loses its last head, so no bucket is emptied."""
    spark, run = batch.sparkSession, uuid.uuid4().hex
    held = _touched(batch, path, key, buckets)
    new = load(None if held is None else held.drop(BUCKET))
    marked = new.withColumns({RUN: F.lit(run), BATCH: F.lit(batch_id)})
    marked.write.option("compression", PACKED).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(f"{path}/rows")
    stored = spark.read.schema(marked.schema).parquet(f"{path}/rows")
    new = stored.where((F.col(BATCH) == batch_id) & (F.col(RUN) == run)).drop(BATCH, RUN)  # a batch without new rows leaves what it wrote before
    if not new.isEmpty():
        rows = head(new)
        placed = (rows if held is None else held.select(*rows.columns).unionByName(rows)).withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        heads, apart = heads_of(placed.repartition(buckets, BUCKET)), f"{shared_folder(spark)}/heads"
        heads.write.option("compression", PACKED).partitionBy(BUCKET).parquet(apart)  # made in full before the old ones are replaced
        heads = spark.read.schema(heads.schema).parquet(apart)
        heads.write.option("compression", PACKED).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{path}/heads")
    return new


def load_sat_with_heads(stage: DataFrame, path: str, batch_id: str, pk: str, hashdiff: str, payload: Sequence[str], buckets: int = 64) -> DataFrame:
    """Load a batch of a standard satellite below ``path``; gives its new rows, those of ``load_sat``."""

    def heads(rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in (BUCKET, pk, LDTS)]
        return rows.groupBy(BUCKET, pk).agg(F.max(F.struct(LDTS, *others)).alias("x")).select(BUCKET, pk, "x.*").select(*rows.columns)

    return _load(stage.where(F.col(pk).isNotNull()), path, batch_id, [pk], buckets, lambda known: load_sat(stage, None, pk, hashdiff, payload, known), heads)


def load_ma_sat_with_heads(stage: DataFrame, path: str, batch_id: str, pk: str, cdk: Sequence[str], hashdiff: str, payload: Sequence[str], buckets: int = 64) -> DataFrame:
    """Load a batch of a multi-active satellite below ``path``; gives its new rows, those of ``load_ma_sat``."""

    def heads(rows: DataFrame) -> DataFrame:
        last = rows.groupBy(BUCKET, pk).agg(F.max(F.struct(LDTS, "_kv_set")).alias("x"))
        return last.select(BUCKET, pk, "x.*").select(*rows.columns)

    def head(new: DataFrame) -> DataFrame:
        return _last_sets(_sets(new, pk, cdk, hashdiff), pk)  # a member is loaded once

    return _load(stage.where(F.col(pk).isNotNull()), path, batch_id, [pk], buckets, lambda known: load_ma_sat(stage, None, pk, cdk, hashdiff, payload, known), heads, head)


def load_eff_sat_with_heads(batch: DataFrame, path: str, batch_id: str, pk: str, dfk: Sequence[str], sfk: Sequence[str], buckets: int = 64) -> DataFrame:
    """Load a snapshot of an effectivity satellite below ``path``; gives its new rows, those of
    ``load_eff_sat``. Heads are the open relationships, by driving key; of one load time an opening
    record counts after a closing one."""

    def load(current: DataFrame | None) -> DataFrame:
        if current is not None:
            keys = batch.select(F.struct(*dfk).alias("_kv_key")).distinct()
            current = current.withColumn("_kv_key", F.struct(*dfk)).join(keys, "_kv_key", "left_semi").drop("_kv_key")
        return load_eff_sat(batch, None, pk, dfk, sfk, current)

    def heads(rows: DataFrame) -> DataFrame:
        last = Window.partitionBy(BUCKET, pk).orderBy(F.col(LDTS).desc(), F.col("END_DATE").desc())  # an open row, and a closing or opening one
        latest = rows.withColumn("_kv_n", F.row_number().over(last)).where("_kv_n = 1").drop("_kv_n")
        return latest.where(F.col("END_DATE") == high_date(batch))

    return _load(batch, path, batch_id, dfk, buckets, load, heads)
