"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every document gets an exponential key scaled by its quality weight; the smallest keys of a source
are taken until its token budget is met. Whole epochs come first: a source with a target of 2.4
times its size is taken twice completely and for 0.4 of its size by sampling. The prefix sums are
two-level, so that no task orders a whole source: sizes are summed by (source, cell of the key),
and only the one cell of each source in which the budget ends is ordered row by row. What comes out
of that is the last key that is taken, with which every row then decides for itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelvault.llm.common import documents, stored, word_count

#: Up to so many sources their targets are broadcast and ordered by one task; beyond, both are spread.
BROADCAST_SOURCES = 50_000


def default_quality(size: Column) -> Column:
    """Weight of a document in sampling: short fragments count less, from 0.1 up to 1 at 200 words."""
    return F.lit(0.1) + F.least(size, F.lit(200)) * F.lit(0.0045)


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) that only the id and the seed decide; without an id the text does."""
    known = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), known).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], single: int) -> DataFrame:
    """``df`` with, for each row, the ``sums`` over the rows before it in ``order``.

    Up to ``single`` rows one task orders them. More are dealt to ranges of the order, each summed by
    itself, and what all ranges before hold (one row a range) is added."""
    before = (Window.unboundedPreceding, -1)
    if df.count() <= single:
        return df.withColumns({n: F.coalesce(F.sum(c).over(Window.orderBy(*order).rowsBetween(*before)), F.lit(0.0)) for n, c in sums.items()})
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n, *order).withColumn("_kv_range", F.spark_partition_id()), "ranges")
    local = Window.partitionBy("_kv_range").orderBy(*order).rowsBetween(*before)
    totals = ranged.groupBy("_kv_range").agg(*[F.sum(c).alias(f"_kv_t_{n}") for n, c in sums.items()])
    across = Window.orderBy("_kv_range").rowsBetween(*before)
    offsets = totals.select("_kv_range", *[F.coalesce(F.sum(f"_kv_t_{n}").over(across), F.lit(0.0)).alias(f"_kv_o_{n}") for n in sums])
    met = ranged.join(F.broadcast(offsets), "_kv_range")  # a row a range
    return met.withColumns({n: F.coalesce(F.sum(c).over(local), F.lit(0.0)) + F.col(f"_kv_o_{n}") for n, c in sums.items()}).drop("_kv_range", *[f"_kv_o_{n}" for n in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, single: int = BROADCAST_SOURCES) -> DataFrame:
    """(source, source_size) to the same with ``target``: the total shared by weight, capped at
    ``most`` times the source's size, the excess reshared by weight until none is above.

    Sources are ordered by code point, null last, and take the weights in turn. Sums are of whole
    numbers in doubles, so their order doesn't matter up to 2 ** 53 words."""
    name = F.col("source").asc_nulls_last()
    placed = running(stored(sizes.select("source", "source_size"), "sizes"), [name], {"_kv_place": F.lit(1.0)}, single)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_kv_place") % len(weights) + 1).cast("int"))
    capped = placed.select("source", "source_size", (F.col("source_size") * most).cast("double").alias("_kv_cap"), weight.alias("_kv_w"))
    capped = stored(capped.withColumn("_kv_at", F.col("_kv_cap") / F.col("_kv_w")), "caps")
    shares = running(capped, [F.col("_kv_at"), name], {"_kv_caps": F.col("_kv_cap"), "_kv_ws": F.col("_kv_w")}, single)
    whole = capped.agg(F.sum("source_size").cast("double").alias("_kv_all"), F.sum("_kv_w").alias("_kv_allw"))
    full = F.col("_kv_cap") * (F.col("_kv_allw") - F.col("_kv_ws")) <= F.col("_kv_w") * (F.col("_kv_all") - F.col("_kv_caps"))
    shares = stored(shares.crossJoin(F.broadcast(whole)).withColumn("_kv_full", full), "shares")  # whole is a single row
    used = shares.agg(F.coalesce(F.sum(F.when(F.col("_kv_full"), F.col("_kv_cap"))), F.lit(0.0)).alias("_kv_used"), F.coalesce(F.sum(F.when(F.col("_kv_full"), F.col("_kv_w"))), F.lit(0.0)).alias("_kv_usedw"))
    rest = F.col("_kv_w") * (F.col("_kv_all") - F.col("_kv_used")) / F.nullif(F.col("_kv_allw") - F.col("_kv_usedw"), F.lit(0.0))
    level = F.when(F.col("_kv_full"), F.col("_kv_cap")).otherwise(rest)
    return shares.crossJoin(F.broadcast(used)).select("source", "source_size", level.alias("target"))  # used is a single row


def planned(docs: DataFrame, seed: int, weights: tuple[int, ...], most: int, cells: int, quality, size: Column) -> DataFrame:
    """``docs`` with _kv_size, _kv_source_size, _kv_target and _kv_times, under its own columns."""
    sized = docs.withColumn("_kv_size", size)
    key = -F.log(uniform(F.col("doc_id"), F.col("text"), seed)) / quality(F.col("_kv_size"))
    keyed = sized.withColumn("_kv_key", key).withColumn("_kv_cell", F.floor((1 - F.exp(-F.col("_kv_key"))) * cells).cast("int"))
    keyed = keyed.withColumns({"_kv_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_kv_text": F.xxhash64("text")})
    order = ["_kv_key", "_kv_id", "_kv_text", "_kv_size"]
    narrow = stored(keyed.select("source", "_kv_cell", *order), "sizes")

    sums = stored(narrow.groupBy("source", "_kv_cell").agg(F.sum("_kv_size").alias("_kv_sum")), "cells")
    targets = source_targets(sums.groupBy("source").agg(F.sum("_kv_sum").alias("source_size")), weights, most)
    plan = targets.withColumn("_kv_epochs", F.least(F.lit(most), F.floor(F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0)))).cast("long"))
    plan = plan.withColumn("_kv_budget", F.col("target") - F.col("_kv_epochs") * F.col("source_size"))
    plan = stored(plan.withColumnsRenamed({"source": "_kv_source", "source_size": "_kv_source_size", "target": "_kv_target"}), "targets")
    small = plan.count() <= BROADCAST_SOURCES

    def by_source(rows: DataFrame, table: DataFrame) -> DataFrame:
        """A row meets a table of sources by its source alone."""
        return rows.join(F.broadcast(table) if small else table, F.col("source").eqNullSafe(F.col("_kv_source")), "left")

    # The cell of each source in which its budget ends, and what is taken before it.
    before = Window.partitionBy("source").orderBy("_kv_cell").rowsBetween(Window.unboundedPreceding, -1)
    cumulated = sums.withColumn("_kv_before", F.coalesce(F.sum("_kv_sum").over(before), F.lit(0)))
    ends = by_source(cumulated, plan).where(F.col("_kv_before") + F.col("_kv_sum") > F.col("_kv_budget"))
    ends = ends.groupBy("source").agg(F.min("_kv_cell").alias("_kv_end"), F.min("_kv_before").alias("_kv_before"), F.min("_kv_budget").alias("_kv_budget"))
    ends = stored(ends.withColumnRenamed("source", "_kv_source"), "ends")

    # The rows of that cell, equal ones as one with their number, in order, up to the last that is taken in part.
    there = by_source(narrow, ends).where(F.col("_kv_cell") == F.col("_kv_end"))
    groups = there.groupBy("source", "_kv_before", "_kv_budget", *order).agg(F.count("*").alias("_kv_n"))
    line = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_kv_before") + F.coalesce(F.sum(F.col("_kv_size") * F.col("_kv_n")).over(line), F.lit(0))
    # Of n equal rows the first ones whose middle lies within the budget.
    fits = at + F.col("_kv_size") / 2 <= F.col("_kv_budget")
    some = F.when((F.col("_kv_n") == 1) | (F.col("_kv_size") == 0), F.when(fits, F.col("_kv_n")).otherwise(0)).otherwise(F.floor((F.col("_kv_budget") - at) / F.col("_kv_size") + 0.5))
    groups = groups.withColumn("_kv_some", F.least(F.col("_kv_n"), F.greatest(F.lit(0), some)).cast("long"))
    last = groups.where("_kv_some > 0").groupBy("source").agg(F.max(F.struct(*order, "_kv_n", "_kv_some")).alias("_kv_last"))
    last = stored(last.withColumnRenamed("source", "_kv_from"), "last")

    whole = stored(plan.join(ends.select(F.col("_kv_source").alias("_kv_to"), "_kv_end"), F.col("_kv_source").eqNullSafe(F.col("_kv_to")), "left").join(last, F.col("_kv_source").eqNullSafe(F.col("_kv_from")), "left").drop("_kv_to", "_kv_from"), "plan")
    rows = by_source(keyed, whole)
    own, bound = F.struct(*order), F.struct(*[F.col(f"_kv_last.{c}").alias(c) for c in order])
    inside = F.coalesce(F.col("_kv_last").isNotNull() & (own <= bound), F.lit(False))
    taken = F.when(F.col("_kv_end").isNull() | (F.col("_kv_cell") < F.col("_kv_end")), True).when(F.col("_kv_cell") > F.col("_kv_end"), False).otherwise(inside)
    rows = rows.withColumn("_kv_in", taken)
    if not last.where("_kv_last._kv_some < _kv_last._kv_n").isEmpty():
        # Equal rows of which only some are taken: they are numbered, and all others stay out of that.
        split = F.coalesce((own == bound) & (F.col("_kv_last._kv_some") < F.col("_kv_last._kv_n")), F.lit(False))
        number = F.row_number().over(Window.partitionBy("source", *order).orderBy(F.lit(1)))
        rows = rows.where(~split).unionByName(rows.where(split).withColumn("_kv_in", number <= F.col("_kv_last._kv_some")))
    times = F.least(F.lit(most), F.col("_kv_epochs") + F.col("_kv_in").cast("long")).cast("int")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], "_kv_size", "_kv_source_size", "_kv_target", times.alias("_kv_times"))


def mix(docs: DataFrame, seed: int = 10, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, cells: int = 4096, quality=default_quality, size: Column | None = None) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``times`` (how often the document is taken)
    and ``taken`` (words taken, repeats counted).

    A document's ``times`` are the epochs it is in, at most ``most``; ``taken`` is its size times
    these. Null, empty and blank texts have size 0 and are taken as often as others of the source;
    the null source is a source; a document without an id has a key by its text. Documents of one
    key are ordered by id and text; equal rows are separate rows, of which as many are taken as fit.
    Texts of any length are counted whole; an empty table gives an empty table. Columns of docs with
    the names of the new ones are replaced. ``cells`` sets how finely keys are cut, not what is
    taken. ``size`` gives sizes that are known already, instead of counting words."""
    names = {"size": F.col("_kv_size"), "source_size": F.col("_kv_source_size"), "target": F.col("_kv_target"), "times": F.col("_kv_times"), "taken": F.col("_kv_size") * F.col("_kv_times")}
    own = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    out = planned(docs, seed, weights, most, cells, quality, word_count(F.col("text")) if size is None else size)
    return out.select(*own, *[c.alias(n) for n, c in names.items()])


def repeated(docs: DataFrame, seed: int = 10, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Every row of ``docs`` as often as ``mix`` takes it, with the columns of ``docs`` as they are."""
    out = planned(docs, seed, weights, most, 4096, default_quality, word_count(F.col("text"))).where("_kv_times > 0")
    return out.withColumn("_kv_time", F.explode(F.sequence(F.lit(1), F.col("_kv_times")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    # Words are counted once; a text is needed only where an id is missing.
    narrow = stored(docs.select("doc_id", "source", F.when(F.col("doc_id").isNull(), F.col("text")).alias("text"), word_count(F.col("text")).alias("n")), "sized")
    return mix(narrow, size=F.col("n")).select("doc_id", "size", "source_size", "target", "taken")


#: The oracle states the rule row by row: one running sum over each source, without cells.
ORACLE_OP10 = r"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), keyed AS (
  SELECT *, -ln((('0x' || substr(md5('10:' || coalesce(CAST(doc_id AS VARCHAR), 'null' || md5(coalesce(text, '')))), 1, 12))::BIGINT + 0.5) / 281474976710656.0)
            / (0.1 + least(size, 200) * 0.0045) AS k FROM sized
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source
), w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM s
), b AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS alls, sum(w) OVER () AS allw,
    coalesce(sum(cap) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS ws
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, cap * (allw - ws) <= w * (alls - caps) AS isfull FROM b
), t AS (
  SELECT source, source_size, CASE WHEN isfull THEN cap ELSE
    w * (alls - sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER ()) / nullif(allw - sum(CASE WHEN isfull THEN w ELSE 0 END) OVER (), 0) END AS target FROM f
), e AS (
  SELECT *, least(3, CAST(floor(coalesce(target / nullif(source_size, 0), 0)) AS BIGINT)) AS epochs FROM t
), r AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (epochs + CASE WHEN before + size / 2 <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
