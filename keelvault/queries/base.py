"""Registration of queries with their SQL, and pieces of SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def canon(c: str) -> str:
    text = f"nullif(upper(trim(CAST({c} AS VARCHAR))), '')"
    for sign in ("\\", "|", "^"):
        text = f"replace({text}, '{sign}', '\\{sign}')"
    return f"coalesce({text}, '^^')"


def hashed(*cols: str) -> str:
    """SQL of a hash key."""
    return f"md5(concat_ws('||', {', '.join(canon(c) for c in cols)}))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HIGH = "TIMESTAMP '9999-12-31 00:00:00'"
