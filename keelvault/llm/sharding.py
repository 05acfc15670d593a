"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Rows are dealt to logical partitions by a hash of their values. The number of rows that each
partition sends to each shard is drawn once, exactly as a uniform shuffle would have it
(multivariate hypergeometric, shard sizes at most one apart). Each partition permutes its rows and
cuts them by its row of the matrix; every shard permutes what it receives. Ranks are taken over
narrow keys only: what leaves is, for each partition, the keys at its cuts, so whole rows find
their shard by comparison and are exchanged once, by shard and cell, where their slot is set."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelvault.llm.common import documents, stored

#: Rows of a logical partition, and the bounds on the number of partitions (one count each on the driver).
PARTITION_ROWS, LEAST_PARTITIONS, MOST_PARTITIONS = 10_000, 512, 65_536
#: Copies of a row that one task makes.
COPIES = 10_000
#: Keys of up to so many groups of equal rows are broadcast; beyond, they are joined by shuffle.
BROADCAST_EQUAL = 200_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Number of good items among ``n`` drawn from ``good + bad``, for counts of any size."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(a: int, b: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, n - mode) - log_choose(good + bad, n))
    left = right = at_mode
    i = j = mode
    u = rng.random() - at_mode
    while u > 0 and (i > low or j < high):  # outwards from the mode, in turn
        if j < high:
            right *= (good - j) * (n - j) / ((j + 1) * (bad - n + j + 1))
            j += 1
            u -= right
            if u <= 0:
                return j
        if i > low:
            left *= i * (bad - n + i) / ((good - i + 1) * (n - i + 1))
            i -= 1
            u -= left
            if u <= 0:
                return i
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows from partition i to shard j: row sums are ``counts``, column sums at most one apart."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    left = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = []
    for n in counts:
        row, rest, remaining = [], sum(left), n
        for j in range(shards):
            x = hypergeometric(rng, left[j], rest - left[j], remaining)
            row.append(x)
            rest -= left[j]
            remaining -= x
            left[j] -= x
        matrix.append(row)
    return matrix


def row_values(df: DataFrame) -> list:
    """The columns of ``df`` in a form that can be hashed."""
    plain = lambda kind: not any(x in kind for x in ("map<", "variant"))
    return [F.col(f"`{n}`") if plain(kind) else F.to_json(F.struct(F.col(f"`{n}`"))) for n, kind in df.dtypes]


def told_apart(df: DataFrame, keys: list, equal: DataFrame) -> DataFrame:
    """``df`` with ``_kv_copy``: 0, or for rows equal in all columns their number among these.

    ``equal`` has the keys of such rows and how many there are (``count``). They can't be told apart,
    so each group becomes one row that is multiplied, in chunks over many tasks; no task holds a group."""
    names = [F.col(f"`{c}`") for c in df.columns]
    marks = equal.select(*[F.col(f"_kv_h{i}").alias(f"_kv_e{i}") for i in (1, 2, 3)], F.col("count").alias("_kv_n"))
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_EQUAL else marks
    met = df.select(*names, *keys).join(marks, reduce(lambda a, b: a & b, [F.col(f"_kv_h{i}") == F.col(f"_kv_e{i}") for i in (1, 2, 3)]), "left")
    alone = met.where("_kv_n IS NULL").select(*names, F.lit(0).cast("long").alias("_kv_copy"))
    one = met.where("_kv_n IS NOT NULL").dropDuplicates(["_kv_h1", "_kv_h2", "_kv_h3"])
    last = F.floor((F.col("_kv_n") - 1) / COPIES).cast("long")
    chunks = one.withColumn("_kv_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    if (equal.agg(F.max("count")).first()[0] or 0) > COPIES:
        chunks = chunks.repartition("_kv_h1", "_kv_chunk")
    first = F.col("_kv_chunk") * COPIES
    copies = chunks.withColumn("_kv_copy", F.explode(F.sequence(first, F.least(first + COPIES, F.col("_kv_n")) - 1)))
    return alone.unionByName(copies.select(*names, "_kv_copy"))


def shuffle_to_shards(df: DataFrame, shards: int = 8, seed: int = 20, partitions: int | None = None) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 within a shard).

    Shard sizes differ by at most one row and the result is a function of the rows, ``seed`` and
    ``partitions`` alone, not of settings or of how the rows come. Columns named shard or slot are
    replaced. Nulls are values like any other; equal rows are separate rows, spread like any others;
    an empty table gives an empty table. ``partitions`` (by default one for 10,000 rows, 512 to
    65,536 of them) bounds the matrix that the driver draws: one count a partition."""
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    values = row_values(df)

    def keys(copy) -> list:
        return [F.xxhash64(F.lit(seed * 10 + i), *values, copy).alias(f"_kv_h{i}") for i in (1, 2, 3)]

    alone = keys(F.lit(0).cast("long"))
    narrow = stored(df.select(*alone), "keys")
    equal = stored(narrow.groupBy("_kv_h1", "_kv_h2", "_kv_h3").count().where("count > 1"), "equal")
    rows = df.withColumn("_kv_copy", F.lit(0).cast("long"))
    if not equal.isEmpty():
        rows = told_apart(df, alone, equal)
        narrow = stored(rows.select(*keys(F.col("_kv_copy"))), "keys")
    parts = partitions or min(MOST_PARTITIONS, max(LEAST_PARTITIONS, narrow.count() // PARTITION_ROWS))
    cells = max(1, parts // shards)
    part = F.pmod("_kv_h1", F.lit(parts)).cast("int").alias("_kv_part")
    cell = F.pmod("_kv_h3", F.lit(cells)).cast("int").alias("_kv_cell")

    counted = {r[0]: r[1] for r in narrow.groupBy(part).count().collect()}  # one row a partition
    matrix = communication_matrix([counted.get(p, 0) for p in range(parts)], shards, seed)
    cuts = spark.createDataFrame([(p, [int(c) for c in np.cumsum(row[:-1])]) for p, row in enumerate(matrix)], "_kv_part int, _kv_cuts array<long>")

    # The key at each cut: the first row behind it, as often as shards begin there.
    local = Window.partitionBy("_kv_part").orderBy("_kv_h2", "_kv_h3")
    ranked = narrow.select("*", part).withColumn("_kv_rank", (F.row_number().over(local) - 1).cast("long"))
    begins = F.size(F.filter("_kv_cuts", lambda c: c == F.col("_kv_rank")))
    at_cuts = ranked.join(F.broadcast(cuts), "_kv_part").withColumn("_kv_begins", begins).where("_kv_begins > 0")
    at_cuts = at_cuts.select("_kv_part", F.explode(F.array_repeat(F.struct("_kv_h2", "_kv_h3"), F.col("_kv_begins"))).alias("_kv_key"))
    bounds = stored(at_cuts.groupBy("_kv_part").agg(F.collect_list("_kv_key").alias("_kv_bounds")), "bounds")  # at most ``shards`` - 1 a partition

    def sharded(keyed: DataFrame) -> DataFrame:
        key = F.struct("_kv_h2", "_kv_h3")
        met = keyed.select("*", part, cell).join(F.broadcast(bounds), "_kv_part", "left")  # at most ``partitions`` rows
        return met.withColumn("shard", F.coalesce(F.size(F.filter("_kv_bounds", lambda b: b <= key)), F.lit(0)).cast("int")).drop("_kv_part", "_kv_bounds")

    before = Window.partitionBy("shard").orderBy("_kv_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sharded(narrow).groupBy("shard", "_kv_cell").count().select("shard", "_kv_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_kv_start"))
    starts = stored(starts, "starts")
    inner = Window.partitionBy("shard", "_kv_cell").orderBy("_kv_h3", "_kv_h1")
    return (
        sharded(rows.select(*[F.col(f"`{c}`") for c in df.columns], *keys(F.col("_kv_copy"))))
        .join(F.broadcast(starts), ["shard", "_kv_cell"])  # at most shards * cells rows
        .withColumn("slot", (F.col("_kv_start") + F.row_number().over(inner) - 1).cast("long"))
        .select(*[F.col(f"`{c}`") for c in df.columns], "shard", "slot")
    )


def op5_hypergeometric_shards(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle_to_shards(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
