"""Profiling columns and ranking key candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelvault.operators.stage import LDTS

GUID = "^[{(]?[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}[)}]?$"
UNIQUE_ENOUGH, NULLS_ALLOWED = 0.95, 0.05
KEY_NAME = "(?i)(key|id|code|nr|no|number)$"


def profile_columns(df: DataFrame, approx: bool = False, error: float = 0.02) -> DataFrame:
    """One row a column: row_count, null_ratio, distinct_count and uniqueness_ratio (distinct values
    over non-null ones; 0 when there are none).

    Exact counts aggregate (column, value) pairs, combined before the shuffle; ``approx`` takes one
    pass with sketches, for very wide or large tables."""
    names = df.columns
    if approx:
        aggs = [F.count("*").alias("n")]
        for i, c in enumerate(names):
            aggs += [F.count(c).alias(f"v{i}"), F.approx_count_distinct(c, error).alias(f"d{i}")]
        one = df.agg(*aggs)
        rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("row_count"), F.col(f"v{i}").alias("v"), F.col(f"d{i}").alias("d")) for i, c in enumerate(names)]))
        long = one.select(rows.alias("x")).select("x.*")
    else:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in names]))
        values = df.select(cells.alias("x")).select("x.*").groupBy("column_name", "value").agg(F.count("*").alias("n"))
        long = values.groupBy("column_name").agg(F.sum("n").alias("row_count"), F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("v"), F.count("value").alias("d"))
    filled = F.coalesce(F.col("d") / F.nullif("v", F.lit(0)), F.lit(0.0))
    return long.select("column_name", "row_count", (1 - F.col("v") / F.col("row_count")).alias("null_ratio"), F.col("d").alias("distinct_count"), filled.alias("uniqueness_ratio"))


#: log2 of the registers of a column's sketch (a standard error of about 1.6 %), and the size of its quantile sketch.
REGISTERS, QUANTILES = 12, 400


def profile_sketches(df: DataFrame) -> DataFrame:
    """One row a column with mergeable state: (column_name, row_count, filled, hll, kll). ``hll`` sketches the
    distinct values as text, ``kll`` the quantiles of numeric columns (null for others).

    States of parts of a table add up to the state of the whole: see ``united_sketches``."""
    aggs = [F.count("*").alias("n")]
    for i, (c, kind) in enumerate(df.dtypes):
        numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
        quantiles = F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(QUANTILES)) if numeric else F.lit(None).cast("binary")
        aggs += [F.count(c).alias(f"v{i}"), F.hll_sketch_agg(F.col(c).cast("string"), F.lit(REGISTERS)).alias(f"h{i}"), quantiles.alias(f"q{i}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col("n").alias("row_count"), F.col(f"v{i}").alias("filled"), F.col(f"h{i}").alias("hll"), F.col(f"q{i}").alias("kll")) for i, c in enumerate(df.columns)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def united_sketches(sketches: DataFrame) -> DataFrame:
    """The state of a whole table from the states of its batches: a row a column."""
    return sketches.groupBy("column_name").agg(F.sum("row_count").alias("row_count"), F.sum("filled").alias("filled"), F.hll_union_agg("hll").alias("hll"), F.when(F.count("kll") > 0, F.kll_merge_agg_double("kll")).alias("kll"))


def profile_of(sketches: DataFrame) -> DataFrame:
    """The profile that states give, with the columns of ``profile_columns`` and ``low``, ``median`` and
    ``high`` (quantiles 0.05, 0.5, 0.95) of numeric columns.

    A sketch is united with itself before it is read, which changes none of its registers: one-pass and
    united sketches have the same registers, and are then read in the same way."""
    distinct = F.hll_sketch_estimate(F.hll_union("hll", "hll"))
    ratio = F.coalesce(F.least(F.lit(1.0), F.col("distinct_count") / F.nullif("filled", F.lit(0))), F.lit(0.0))
    out = sketches.withColumn("distinct_count", F.when(F.col("filled") > 0, distinct).otherwise(0))
    nulls = F.coalesce(1 - F.col("filled") / F.nullif("row_count", F.lit(0)), F.lit(0.0))
    marks = [F.when(F.col("kll").isNotNull() & (F.col("filled") > 0), F.kll_sketch_get_quantile_double("kll", F.lit(q))).alias(n) for n, q in (("low", 0.05), ("median", 0.5), ("high", 0.95))]
    return out.select("column_name", "row_count", nulls.alias("null_ratio"), "distinct_count", ratio.alias("uniqueness_ratio"), *marks)


def add_to_profile(batch: DataFrame, path: str, batch_id: str) -> None:
    """Keep the state of a batch in the table at ``path``: a few rows a batch, whatever its size. The same
    batch again replaces its own state, so a repeated run changes nothing."""
    made = profile_sketches(batch).withColumn("batch_id", F.lit(batch_id))
    made.coalesce(1).write.mode("overwrite").partitionBy("batch_id").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_profile(spark, path: str) -> DataFrame:
    """The profile of all batches at ``path``: only states are read, no batch."""
    return profile_of(united_sketches(spark.read.parquet(path)))


def example_values(df: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` first distinct values of each column, as text in order of code points."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in df.columns]))
    values = df.select(cells.alias("x")).select("x.*").where("value IS NOT NULL").distinct()
    # Slices of a column keep their own first values, so that no task orders a whole column.
    w = Window.partitionBy("column_name", F.pmod(F.xxhash64("value"), F.lit(64))).orderBy("value")
    few = values.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    return few.groupBy("column_name").agg(F.slice(F.sort_array(F.collect_list("value")), 1, n).alias("example_values"))


def key_plausible(profile: DataFrame) -> DataFrame:
    return profile.where((F.col("uniqueness_ratio") >= UNIQUE_ENOUGH) & (F.col("null_ratio") <= NULLS_ALLOWED))


def flag_technical_guid(df: DataFrame) -> DataFrame:
    """(column_name, guid_ratio, technical_guid): perfectly unique columns of GUID shape are no keys."""
    aggs = []
    for i, c in enumerate(df.columns):
        s = F.col(c).cast("string")
        aggs += [F.avg(s.rlike(GUID).cast("int")).alias(f"g{i}")]
    one = df.agg(*aggs)
    long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"g{i}"), F.lit(0.0)).alias("guid_ratio")) for i, c in enumerate(df.columns)])).alias("x")).select("x.*")
    unique = profile_columns(df).select("column_name", "uniqueness_ratio")
    return long.join(unique, "column_name").select("column_name", "guid_ratio", ((F.col("guid_ratio") == 1) & (F.col("uniqueness_ratio") == 1)).alias("technical_guid"))


def flag_low_cardinality(profile: DataFrame, below: float = 0.01) -> DataFrame:
    """Columns with the name of a key but few values, such as branch codes."""
    return profile.where(F.col("column_name").rlike(KEY_NAME) & (F.col("uniqueness_ratio") < below))


def rank_key_candidates(profile: DataFrame, guids: DataFrame | None = None, stability: DataFrame | None = None) -> DataFrame:
    """Plausible keys in order: not a technical GUID, stable, unique, without nulls, by name.

    ``stability`` is (column_name, changed_ratio)."""
    out = key_plausible(profile)
    out = out.join(guids.select("column_name", "technical_guid"), "column_name", "left") if guids is not None else out.withColumn("technical_guid", F.lit(False))
    out = out.join(stability.select("column_name", "changed_ratio"), "column_name", "left") if stability is not None else out.withColumn("changed_ratio", F.lit(0.0))
    out = out.fillna({"technical_guid": False, "changed_ratio": 0.0})
    order = [F.col("technical_guid"), F.col("changed_ratio"), F.col("uniqueness_ratio").desc(), F.col("null_ratio"), F.col("column_name")]
    return out.withColumn("key_rank", F.rank().over(Window.orderBy(*order)).cast("long"))  # one row a column


def key_stability(old: DataFrame, new: DataFrame, identity: str, keys: Sequence[str]) -> DataFrame:
    """(column_name, n_objects, changed_ratio): for each candidate key the share of objects, matched by
    a second identifier, whose key differs between two snapshots."""
    o = old.select(identity, *[F.col(k).alias(f"_kv_o{i}") for i, k in enumerate(keys)])
    n = new.select(identity, *[F.col(k).alias(f"_kv_n{i}") for i, k in enumerate(keys)])
    one = o.join(n, identity).agg(F.count("*").alias("n"), *[F.avg((~F.col(f"_kv_o{i}").eqNullSafe(F.col(f"_kv_n{i}"))).cast("int")).alias(f"c{i}") for i in range(len(keys))])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("column_name"), F.col("n").alias("n_objects"), F.col(f"c{i}").alias("changed_ratio")) for i, k in enumerate(keys)]))
    return one.select(rows.alias("x")).select("x.*")


def change_rate(sat: DataFrame, pk: str, attributes: Sequence[str], wide: int = 30) -> DataFrame:
    """Per attribute the share of versions after the first in which it changed, and the payload's width."""
    w = Window.partitionBy(pk).orderBy(LDTS)
    steps = sat.select(F.row_number().over(w).alias("_kv_n"), *[(~F.col(a).eqNullSafe(F.lag(a).over(w))).cast("int").alias(a) for a in attributes]).where("_kv_n > 1")
    one = steps.agg(*[F.avg(a).alias(a) for a in attributes])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.col(a), F.lit(0.0)).alias("change_rate")) for a in attributes]))
    return one.select(rows.alias("x")).select("x.*", F.lit(len(attributes)).alias("payload_width"), F.lit(len(attributes) > wide).alias("too_wide"))
