"""Extending a live vault, and proof that nothing stored has changed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelvault.operators.load import load_hub
from keelvault.operators.stage import LDTS, SOURCE
from keelvault.sources.feeds import written


def add_feed(hub: DataFrame, new_stage: DataFrame, pk: str, nk: str) -> DataFrame:
    """The hub with the new keys of another feed; rows and first-load times that are there stay."""
    return hub.unionByName(load_hub(new_stage, hub, pk, nk).select(*hub.columns))


def row_text(columns: Sequence[str]) -> Column:
    """A row's values as one text that no other row of the columns has: each with its length, null marked."""
    texts = [F.col(f"`{c}`").cast("string") for c in columns]
    return F.concat(F.lit(""), *[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("^")) for t in texts])


def row_hash(columns: Sequence[str]) -> Column:
    """md5 of a row's values; a null differs from any text."""
    return F.md5(row_text(columns).cast("binary"))


def diff_tables(before: DataFrame, after: DataFrame, key: Sequence[str], gained: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """(key columns, status): unchanged, changed (other values), new or removed, by a hash of the
    columns of ``before``. Keys may be null; they are unique in either table.

    ``gained`` names the feeds and satellites that an extension has added, with their rows: a key
    that is otherwise unchanged and occurs in one of them is extended. ``gained`` is then a column as
    well, the names of those that have the key, in order."""
    hashed = row_hash([c for c in before.columns if c not in key])
    a = before.select(*[F.col(k).alias(f"_kv_{k}") for k in key], hashed.alias("_kv_ha"))
    b = after.select(*key, hashed.alias("_kv_hb"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_kv_{k}")) for k in key])
    status = F.when(F.col("_kv_ha").isNull(), "new").when(F.col("_kv_hb").isNull(), "removed").when(F.col("_kv_ha") == F.col("_kv_hb"), "unchanged").otherwise("changed")
    names = [F.coalesce(k, f"_kv_{k}").alias(k) for k in key]
    out = a.join(b, same, "full_outer").select(*names, status.alias("status"))
    if gained is None:
        return out
    held = [df.select(*[F.col(k).alias(f"_kv_{k}") for k in key]).distinct().withColumn("_kv_name", F.lit(n)) for n, df in gained.items()]
    by_key = reduce(lambda x, y: x.unionByName(y), held).groupBy(*[f"_kv_{k}" for k in key]).agg(F.array_join(F.sort_array(F.collect_list("_kv_name")), ",").alias("gained"))  # a name a table
    met = out.join(by_key, same, "left").withColumn("gained", F.coalesce("gained", F.lit("")))
    grown = (F.col("status") == "unchanged") & (F.col("gained") != "")
    return met.select(*key, F.when(grown, "extended").otherwise(F.col("status")).alias("status"), "gained")


def content_hash(df: DataFrame) -> DataFrame:
    """(n_rows, fingerprint): the same for the same rows in any order, as often as they occur. The
    fingerprint is the sum of 60 bits of each row's md5, as text; nulls keep their place."""
    h = F.conv(F.substring(row_hash(df.columns), 1, 15), 16, 10).cast("decimal(20,0)")
    total = F.coalesce(F.sum(h).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("n_rows"), total.cast("string").alias("fingerprint"))


def preserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(n_before, n_kept, score): rows of ``before`` that are in ``after`` unchanged, counted as often
    as they occur. 1.0 for an empty table."""
    gone = before.exceptAll(after.select(*before.columns)).agg(F.count("*").alias("n_gone"))
    one = before.agg(F.count("*").alias("n_before")).crossJoin(gone)  # two single rows
    kept = F.col("n_before") - F.col("n_gone")
    return one.select("n_before", kept.alias("n_kept"), F.coalesce(kept / F.nullif("n_before", F.lit(0)), F.lit(1.0)).alias("score"))


#: Buckets of a hashed table, and how many nodes of its hash tree have one parent.
BUCKETS, FAN = 256, 16
BUCKET = "_kv_bucket"


def _digests(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(level, node, n, digest): the leaves of a hash tree, one a bucket. Digests are sums over rows, so
    those of parts of a table add up."""
    h = F.conv(F.substring(row_hash(columns), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(F.lit(0).alias("level"), F.col(BUCKET).alias("node")).agg(F.count("*").alias("n"), F.sum(h).cast("decimal(38,0)").alias("digest"))


def _tree(leaves: DataFrame, buckets: int) -> DataFrame:
    """Leaves, and above them one node for each FAN below, up to the root."""
    out, level, width = leaves, 0, buckets
    while width > 1:
        width, level = -(-width // FAN), level + 1
        up = leaves.groupBy(F.lit(level).alias("level"), F.floor(F.col("node") / FAN**level).cast("int").alias("node")).agg(F.sum("n").alias("n"), F.sum("digest").cast("decimal(38,0)").alias("digest"))
        out = out.unionByName(up)
    return out


def append_hashed(rows: DataFrame, path: str, key: Sequence[str], buckets: int = BUCKETS) -> None:
    """Append rows to a table that is laid out by buckets of its key, and their digests to its hash tree.

    The number of buckets stays as it is over the life of a table; rows may have gained columns, which
    the digests then leave out."""
    spark = rows.sparkSession
    try:
        held = spark.read.parquet(f"{path}/rows").columns
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = rows.columns
    columns = sorted(c for c in held if c != BUCKET)
    placed = written(rows.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")), "placed")
    placed.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(f"{path}/rows")
    leaves = _digests(placed, columns).withColumns({"buckets": F.lit(buckets), "columns": F.lit(",".join(columns))})
    leaves.coalesce(1).write.mode("append").parquet(f"{path}/digests")


def read_hashed(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop(BUCKET)


def differing_buckets(spark, before: str, after: str) -> list[int]:
    """The buckets in which two hashed tables differ, found from the root of their hash trees down: only
    digests are read, and below a node only if the node differs."""
    leaves = [spark.read.parquet(f"{p}/digests") for p in (before, after)]
    marks = {tuple(r) for x in leaves for r in x.select("buckets", "columns").distinct().collect()}
    if len(marks) != 1:
        raise ValueError("the tables have other numbers of buckets or other columns: compare them with diff_tables")
    ((buckets, _),) = marks
    trees = [written(_tree(x.groupBy("level", "node").agg(F.sum("n").alias("n"), F.sum("digest").cast("decimal(38,0)").alias("digest")), buckets), "tree") for x in leaves]
    level = max(r["level"] for r in trees[0].select("level").distinct().collect()) if not trees[0].isEmpty() else 0
    found = None
    while level >= 0:
        a, b = (t.where(F.col("level") == level).select("node", F.struct("n", "digest").alias(n)) for t, n in zip(trees, "ab", strict=True))
        if found is not None:
            a, b = (x.where(F.floor(F.col("node") / FAN).isin(found)) for x in (a, b))
        found = sorted(r["node"] for r in a.join(b, "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("node").collect())  # at most all buckets
        if not found:
            return []
        level -= 1
    return found


def diff_hashed(spark, before: str, after: str, key: Sequence[str]) -> DataFrame:
    """(key columns, status): the keys of two hashed tables that are changed, new or removed, as
    ``diff_tables`` gives them. Only buckets whose digests differ are read and joined."""
    found = differing_buckets(spark, before, after)
    a, b = (spark.read.parquet(f"{p}/rows").where(F.col(BUCKET).isin(found)).drop(BUCKET) for p in (before, after))
    return diff_tables(a, b, key).where("status <> 'unchanged'")


def preserved_hashed(spark, before: str, after: str) -> DataFrame:
    """What ``preserved`` gives for two hashed tables; of buckets with equal digests nothing is read."""
    found = differing_buckets(spark, before, after)
    a, b = (spark.read.parquet(f"{p}/rows").where(F.col(BUCKET).isin(found)).drop(BUCKET) for p in (before, after))
    gone = a.exceptAll(b.select(*a.columns)).agg(F.count("*").alias("n_gone"))
    total = spark.read.parquet(f"{before}/digests").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_before"))
    kept = F.col("n_before") - F.col("n_gone")
    return total.crossJoin(gone).select("n_before", kept.alias("n_kept"), F.coalesce(kept / F.nullif("n_before", F.lit(0)), F.lit(1.0)).alias("score"))  # two single rows


#: What a change of the values that a stored key stands for is called, by kind of table.
CHANGED = {"hub": "E_EXISTING_BK_CHANGED", "link": "E_EXISTING_GRAIN_CHANGED", "satellite": "E_EXISTING_SAT_RESHAPED"}


def existing_changes(before: DataFrame, after: DataFrame, construct: str, kind: str, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(severity, code, construct, n_rows): rows of a live table that an extension has removed, and rows
    whose ``values`` (business key, participations or payload) are no longer the same.

    A table that has lost one of the values has changed in all rows, and so has a satellite that has
    gained a column, since that would have to be filled for its history."""
    reshaped = not set(values) <= set(after.columns) or (kind == "satellite" and not set(after.columns) <= set(before.columns))
    held = [c for c in values if c in after.columns]
    a = before.select(*[F.col(k).alias(f"_kv_{k}") for k in key], row_hash(held).alias("_kv_a"))
    b = after.select(*key, row_hash(held).alias("_kv_b"))
    met = a.join(b, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_kv_{k}")) for k in key]), "left")
    differ = F.col("_kv_b").isNotNull() & (F.lit(reshaped) | (F.col("_kv_a") != F.col("_kv_b")))
    one = met.agg(F.count_if(F.col("_kv_b").isNull()).alias("gone"), F.count_if(differ).alias("changed"))
    rows = F.array(F.struct(F.lit("E_EXISTING_REMOVED").alias("code"), F.col("gone").alias("n_rows")), F.struct(F.lit(CHANGED[kind]).alias("code"), F.col("changed").alias("n_rows")))
    return one.select(F.explode(rows).alias("x")).select(F.lit("error").alias("severity"), "x.code", F.lit(construct).alias("construct"), "x.n_rows")


def cross_domain_links(link: DataFrame, origins: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Links whose hubs first came from different sources, with those sources ({foreign key: (hub, key)}).

    Give the first rows of each feed where a hub has several: a key that they brought at the same
    time comes from all of them, so the link crosses nothing if another hub has one of these sources."""
    out = link
    for fk, (hub, pk) in origins.items():
        times = hub.groupBy(F.col(pk).alias(fk), LDTS).agg(F.sort_array(F.collect_set(SOURCE)).alias(SOURCE))  # as many as there are feeds
        first = times.groupBy(fk).agg(F.min(F.struct(LDTS, SOURCE)).alias("x")).select(fk, F.col("x." + SOURCE).alias(f"{fk}_ORIGIN"))
        out = out.join(first, fk)
    names = [f"{fk}_ORIGIN" for fk in origins]
    differ = reduce(lambda a, b: a | b, [~F.arrays_overlap(names[0], n) for n in names[1:]])
    return out.where(differ).withColumns({n: F.element_at(n, 1) for n in names})
