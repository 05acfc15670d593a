"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared one that ``spark.checkpoint.dir`` names.

    Where the setting is absent a folder in the warehouse is used, but only on a single machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_keelvault_checkpoints"
    return f"{top.rstrip('/')}/keelvault-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back.

    Lost executors cost a re-read only, and a table read twice is computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, although ``body`` uses it many times."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows of the held-out fold: crc32 of the id as text, modulo ``folds``, is 0 (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
