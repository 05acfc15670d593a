"""Vault loads. Each gives the new rows for a target; the caller appends them.

Loads are insert-only and idempotent. First rows are found by aggregation, so that rows of a hot
key are combined before they are shuffled; targets are met by anti and semi joins on hash keys. Of
a target with a history only the rows of the batch's keys go into an aggregation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from keelvault.functions.hashing import hash_key, is_blank, packed, unpacked
from keelvault.operators.stage import LDTS, SOURCE, Staged, alias_fk
from keelvault.sources.feeds import shared_folder, union_feeds, written

HIGH_DATE = "9999-12-31 00:00:00"


def _pack(df: DataFrame, columns: Sequence[str], whole: bool = False) -> DataFrame:
    """Hash keys, where they are text, in half their length. ``whole`` says that none is null. Spark else tells
    nulls apart below a join by the whole expression, in which the hash stands again and again."""
    return df.withColumns({c: F.coalesce(packed(c), F.lit(b"")) if whole else packed(c) for c in columns if df.schema[c].dataType == StringType()})


def _unpack(df: DataFrame, columns: Sequence[str], like: DataFrame, whole: bool = False) -> DataFrame:
    return df.withColumns({c: F.coalesce(unpacked(c), F.lit("")) if whole else unpacked(c) for c in columns if like.schema[c].dataType == StringType()})


def _first(rows: DataFrame, pk: str, others: Sequence[str], hashes: Sequence[str] = (), lying: bool = False) -> DataFrame:
    """One row for each pk: the earliest by load time, then by source, then by the other columns. Those of
    ``hashes`` are exchanged in half their length; the pk isn't, so that it meets a bucketed table. Where rows
    of a pk are ``lying`` together already, they are sorted once and not aggregated."""
    rest = [c for c in others if c not in (LDTS, SOURCE)]
    if lying:
        one = Window.partitionBy(pk).orderBy(LDTS, SOURCE, *rest)
        return rows.withColumn("_kv_n", F.row_number().over(one)).where("_kv_n = 1").select(pk, *rest, LDTS, SOURCE)
    least = F.min(F.struct(LDTS, SOURCE, *rest)).alias("x")
    first = _pack(rows, hashes).groupBy(pk).agg(least).select(pk, *[F.col(f"x.{c}").alias(c) for c in [*rest, LDTS, SOURCE]])
    return _unpack(first, hashes, rows)


def _absent(rows: DataFrame, target: DataFrame | None, pk: str) -> DataFrame:
    return rows if target is None else rows.join(target.select(pk), pk, "left_anti")


def load_hub(stages: DataFrame | Sequence[DataFrame], target: DataFrame | None, pk: str, nk: str) -> DataFrame:
    """First row of each new key; feeds of one hub are united. Null and blank keys load nothing."""
    frames = [stages] if isinstance(stages, DataFrame) else list(stages)
    rows = union_feeds([f.select(pk, nk, LDTS, SOURCE) for f in frames]).where(~is_blank(nk))
    return _absent(_first(rows, pk, [nk]), target, pk)


def _new(stage: DataFrame | Staged, target: DataFrame | None, pk: str, others: Sequence[str], fks: Sequence[str], whole: Column, parts: int | None) -> DataFrame:
    """First whole rows of the keys that a target lacks. A ``Staged`` is exchanged by the key into ``parts``
    parts, and meets its target before any other hash is made."""
    if isinstance(stage, Staged):
        return _first(stage.rows(pk, parts, target).where(whole), pk, others, lying=True)
    return _absent(_first(stage.where(whole), pk, others, fks), target, pk)


def load_link(stage: DataFrame | Staged, target: DataFrame | None, pk: str, fks: Sequence[str], keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """First row of each new relationship. Rows with a null participation load nothing, nor do rows
    with a blank one among ``keys``, the business keys of the participations."""
    whole = reduce(lambda a, b: a & b, [*(F.col(c).isNotNull() for c in fks), *(~is_blank(c) for c in keys)])
    return _new(stage, target, pk, list(fks), fks, whole, parts)


def load_t_link(stage: DataFrame | Staged, target: DataFrame | None, pk: str, fks: Sequence[str], payload: Sequence[str], eff: str, degenerate_key: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Insert-once events with payload and event time. Where ``pk`` comes from the participations
    alone, equal pairs of them are one event, unless ``degenerate_key`` names what tells events
    apart: its columns are then hashed into the key. Rows with a null participation or without a
    time load nothing: see ``rejected_events``."""
    if degenerate_key:
        stage = (stage.rows() if isinstance(stage, Staged) else stage).withColumn(pk, hash_key([pk, *degenerate_key]))
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*fks, eff)])
    return _new(stage, target, pk, [*fks, eff, *payload], fks, whole, parts)


def rejected_events(stage: DataFrame, fks: Sequence[str], eff: str) -> DataFrame:
    """Staged events that a transactional link doesn't take, with ``reason``: no_participation, or
    no_event_time where only the time is missing. For quarantine."""
    none = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in fks])
    reason = F.when(none, "no_participation").when(F.col(eff).isNull(), "no_event_time")
    return stage.withColumn("reason", reason).where("reason IS NOT NULL")


def _of_batch(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of a target whose keys (nulls are equal) are in a batch."""
    wanted = batch.select(*[F.col(k).alias(f"_kv_b_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_kv_b_{k}")) for k in keys])
    return target.join(wanted, same, "left_semi")


def _of_keys(target: DataFrame, batch: DataFrame, pk: str, dealt: bool = False) -> DataFrame:
    """The rows of a target whose hash key is in a batch, by plain equality, so that a table bucketed
    by its hash key is not shuffled. A null key is in no table."""
    wanted = _looked_up(batch.select(pk), dealt) if dealt else batch.select(pk).distinct()  # a hash table keeps a key once
    return target.join(wanted, pk, "left_semi").select(*target.columns)


def _wanted(target: DataFrame, batch: DataFrame, pk: str, dealt: bool, n: int, target_rows: int | None) -> DataFrame:
    """What is marked of a target: all of it if it has at most ``WHOLE`` times the ``n`` rows of the batch."""
    return target if target_rows is not None and target_rows <= WHOLE * n else _of_keys(target, batch, pk, dealt)


def _looked_up(keys: DataFrame, dealt: bool) -> DataFrame:
    """Rows of the keys of a batch that is ``dealt`` into parts by its size: a part's keys fit a hash table, so
    what meets them needn't be sorted by key first."""
    return keys.hint("shuffle_hash") if dealt else keys


def _latest(target: DataFrame, pk: str, hashdiff: str) -> DataFrame:
    return target.groupBy(F.col(pk).alias("_kv_pk")).agg(F.max(LDTS).alias("_kv_ldts"), F.max_by(hashdiff, LDTS).alias("_kv_diff"))


def load_sat(stage: DataFrame, target: DataFrame | None, pk: str, hashdiff: str, payload: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """Rows whose hashdiff differs from the row before of the same key, in order of load time.

    Of rows of one key and load time the one with the smallest hashdiff counts. Rows not later than
    the target's latest of their key are not loaded: see ``late_rows``. ``known`` may have the latest
    rows of the batch's keys (pk, LOAD_DATETIME, hashdiff), where they are kept apart from the target."""
    columns = [pk, hashdiff, *payload, LDTS, SOURCE]
    once = stage.where(F.col(pk).isNotNull()).groupBy(pk, LDTS).agg(F.min(F.struct(hashdiff, *payload, SOURCE)).alias("x"))
    once = once.select(pk, LDTS, *[F.col(f"x.{c}").alias(c) for c in (hashdiff, *payload, SOURCE)])
    before = F.lag(hashdiff).over(Window.partitionBy(pk).orderBy(LDTS))
    if target is None and known is None:
        return once.withColumn("_kv_before", before).where(~F.col(hashdiff).eqNullSafe(F.col("_kv_before"))).select(*columns)
    latest = _latest(_of_keys(target, stage, pk), pk, hashdiff) if known is None else known.select(F.col(pk).alias("_kv_pk"), F.col(LDTS).alias("_kv_ldts"), F.col(hashdiff).alias("_kv_diff"))
    met = once.join(latest, F.col(pk) == F.col("_kv_pk"), "left").where(F.col("_kv_ldts").isNull() | (F.col(LDTS) > F.col("_kv_ldts")))
    changed = met.withColumn("_kv_before", F.coalesce(before, "_kv_diff")).where(~F.col(hashdiff).eqNullSafe(F.col("_kv_before")))
    return changed.select(*columns)


def late_rows(stage: DataFrame, target: DataFrame, pk: str, hashdiff: str) -> DataFrame:
    """Staged rows that are older than the target's latest row of their key, or as old and of another
    hashdiff: what ``load_sat`` keeps out, for quarantine."""
    met = stage.join(_latest(_of_keys(target, stage, pk), pk, hashdiff), F.col(pk) == F.col("_kv_pk"))
    late = (F.col(LDTS) < F.col("_kv_ldts")) | ((F.col(LDTS) == F.col("_kv_ldts")) & ~F.col(hashdiff).eqNullSafe(F.col("_kv_diff")))
    return met.where(late).drop("_kv_pk", "_kv_ldts", "_kv_diff")


def load_sat_per_feed(stages: dict[str, DataFrame], targets: dict[str, DataFrame], pk: str, hashdiff: str, payload: Sequence[str]) -> dict[str, DataFrame]:
    """A satellite of a hub with several feeds, one table a feed."""
    return {feed: load_sat(df, targets.get(feed), pk, hashdiff, payload) for feed, df in stages.items()}


def load_sat_bound(stages: dict[str, DataFrame], feed: str, target: DataFrame | None, pk: str, hashdiff: str, payload: Sequence[str]) -> DataFrame:
    """A satellite that one named feed fills."""
    return load_sat(stages[feed], target, pk, hashdiff, payload)


#: Cells that parents are counted in, and the rows of a cell (and times the mean) from which on its parents are spread.
CELLS, HOT_ROWS, HOT_TIMES = 1 << 16, 1 << 22, 16

#: Times the rows of a batch up to which marking all of a target costs less than finding the batch's parents in it.
WHOLE = 2

#: Rows that one task is to hash and sort. Spark sizes tasks by what crosses the exchange, which has no hashes yet.
TASK_ROWS = 1 << 19


def _print(cdk: Sequence[str], hashdiff: str, over: Callable[[Column], Column] = lambda c: c, counts: Column | None = None) -> Column:
    """Mark of a set from its number and sums of hashes of child keys and hashdiffs, over rows that count."""
    return _print_of(*_marks(cdk, hashdiff), over, counts)


#: Columns of the two hashes of a member.
MARKS = ("_kv_mark_1", "_kv_mark_2")


def _marks(cdk: Sequence[str], hashdiff: str) -> list[Column]:
    """Two hashes of a member of a set."""
    values = [c for k in cdk for c in (F.col(k), F.col(k).isNull())]
    return [F.xxhash64(F.lit(i), *values, F.col(hashdiff)) for i in (1, 2)]


def _print_of(one: Column, two: Column, over: Callable[[Column], Column] = lambda c: c, counts: Column | None = None) -> Column:
    """Halves of hashes are added as integers, which make the exact sums in the end."""
    counts = F.lit(True) if counts is None else counts

    def total(mark: Column) -> Column:
        high, low = (over(F.sum(F.when(counts, half))).cast("decimal(20,0)") for half in (F.shiftright(mark, 32), mark.bitwiseAND(F.lit((1 << 32) - 1))))
        return (high * F.lit(1 << 32).cast("decimal(10,0)") + low).cast("decimal(30,0)").cast("string")

    return F.unhex(F.md5(F.concat_ws(",", over(F.count_if(counts)).cast("string"), total(one), total(two)).cast("binary")))


def _sets(once: DataFrame, pk: str, cdk: Sequence[str], hashdiff: str) -> DataFrame:
    """(pk, load time, mark of the set of child keys and hashdiffs): a set is one parent's distinct rows of
    one load, and is never gathered."""
    return once.groupBy(pk, LDTS).agg(_print(cdk, hashdiff).alias("_kv_set"))


def _cells(rows: DataFrame, pk: str) -> tuple[list[int], int, bool]:
    """Cells of parents with so many rows that one task should not have them, at most CELLS / HOT_TIMES, the
    number of all rows, and whether all have one load time."""
    times = [F.min(LDTS).alias("a"), F.max(LDTS).alias("b"), F.count(LDTS).alias("m")]
    cells = rows.groupBy(F.pmod(F.xxhash64(pk), F.lit(CELLS)).alias("c")).agg(F.count("*").alias("n"), *times)
    one = (F.min("a") == F.max("b")) & (F.sum("m") == F.sum("n"))
    n, large, one = cells.agg(F.sum("n"), F.collect_list(F.when(F.col("n") > HOT_ROWS, F.struct("c", "n"))), one).first()
    return [r.c for r in large if r.n > n / CELLS * HOT_TIMES], n or 0, bool(one)


def _hot(rows: DataFrame, pk: str) -> list[int]:
    return _cells(rows, pk)[0]


def _parts(spark: SparkSession, n: int) -> int | None:
    """Parts of ``TASK_ROWS`` rows; None where Spark's own choice, at least a part a core, has no more in each."""
    parts = -(-n // TASK_ROWS)
    return parts if parts > spark.sparkContext.defaultParallelism else None


def load_ma_sat(stage: DataFrame | Staged, target: DataFrame | None, pk: str, cdk: Sequence[str], hashdiff: str, payload: Sequence[str], known: DataFrame | None = None, parts: int | None = None, target_rows: int | None = None) -> DataFrame:
    """Several rows at a time for each parent: when the set of (child key, hashdiff) differs from the
    set before, the whole new set is inserted. ``known`` may have the marks of the latest sets of the batch's
    parents (``set_marks``), where they are kept apart from the target.

    Rows are exchanged once, by parent, and sets are marked and compared where they lie. A ``Staged`` is
    exchanged before its hashes are made, into ``parts`` parts, else parts by its number of rows. Parents
    with very many rows are spread instead: their distinct rows are written, and sets meet rows by a join.
    ``target_rows`` may say how many rows the target has at most: one that is not much larger than the batch is
    marked as a whole, without a look for the batch's parents first."""
    columns = [pk, *cdk, hashdiff, *payload, LDTS, SOURCE]

    def taken(df: DataFrame) -> DataFrame:
        return df.where(F.col(pk).isNotNull()).select(*columns)

    rows = lying = taken(stage.rows() if isinstance(stage, Staged) else stage)
    hot, n, one_time = _cells(rows, pk)
    if isinstance(stage, Staged):
        parts = parts or _parts(rows.sparkSession, n)
        lying = taken(stage.rows(pk, parts))
    dealt = isinstance(stage, Staged) and parts is not None
    if target is not None and known is None:
        known = set_marks(_wanted(target, lying, pk, dealt, n, target_rows), pk, cdk, hashdiff)
    if known is not None:
        known = known.select(F.col(pk).alias("_kv_pk"), F.col(LDTS).alias("_kv_ldts"), F.col("_kv_set").alias("_kv_known"))
    own = Window.partitionBy(pk).orderBy(LDTS)

    def later(df: DataFrame) -> DataFrame:
        if known is None:
            return df.withColumn("_kv_known", F.lit(None).cast("binary"))
        return df.join(_looked_up(known, dealt) if df.schema[pk] == rows.schema[pk] else _pack(known, ["_kv_pk"], True), F.col(pk) == F.col("_kv_pk"), "left").where(F.col("_kv_ldts").isNull() | (F.col(LDTS) > F.col("_kv_ldts")))

    def by_parent(rows: DataFrame) -> DataFrame:
        one = Window.partitionBy(pk, LDTS, *cdk, hashdiff).orderBy(*payload, SOURCE)
        once = later(rows if isinstance(stage, Staged) else _pack(rows, [pk], True).repartition(pk)).withColumn("_kv_n", F.row_number().over(one)).where("_kv_n = 1")
        marked = once.withColumn("_kv_set", _print(cdk, hashdiff, lambda c: c.over(Window.partitionBy(pk, LDTS))))
        if one_time:  # a parent has one set, and the one before is known
            new = (once if known is None else marked.where(~F.col("_kv_set").eqNullSafe(F.col("_kv_known")))).select(*columns)
        else:
            before = F.coalesce(F.lag("_kv_set").over(own), "_kv_known")
            first = ~F.lag(LDTS).over(own).eqNullSafe(F.col(LDTS))
            told = marked.withColumn("_kv_new", F.when(first, ~F.col("_kv_set").eqNullSafe(before)))
            new = told.withColumn("_kv_new", F.max("_kv_new").over(Window.partitionBy(pk, LDTS))).where("_kv_new").select(*columns)
        return new if isinstance(stage, Staged) else _unpack(new, [pk], rows, True)

    def spread(rows: DataFrame) -> DataFrame:
        member = [pk, *cdk, hashdiff, LDTS]
        once = rows.groupBy(*member).agg(F.min(F.struct(*payload, SOURCE)).alias("x")).select(*member, *[F.col(f"x.{c}").alias(c) for c in (*payload, SOURCE)])
        once = written(once, "once")  # read for the sets and for the rows
        sets = later(_sets(once, pk, cdk, hashdiff)).withColumn("_kv_before", F.coalesce(F.lag("_kv_set").over(own), "_kv_known"))
        changed = sets.where(~F.col("_kv_set").eqNullSafe(F.col("_kv_before"))).select(pk, LDTS)
        return once.join(changed, [pk, LDTS], "left_semi").select(*columns)

    return _apart(rows, pk, by_parent, spread, hot, lying)


def _apart(rows: DataFrame, pk: str, by_parent: Callable[[DataFrame], DataFrame], spread: Callable[[DataFrame], DataFrame], hot: Sequence[int], lying: DataFrame | None = None) -> DataFrame:
    """``by_parent`` of the rows (or ``lying``, the same exchanged), and ``spread`` of those of hot cells if there are any."""
    lying = rows if lying is None else lying
    if not hot:
        return by_parent(lying)
    is_hot = F.pmod(F.xxhash64(pk), F.lit(CELLS)).isin(hot)
    return by_parent(lying.where(~is_hot)).unionByName(spread(rows.where(is_hot)))


def set_marks(rows: DataFrame, pk: str, cdk: Sequence[str], hashdiff: str) -> DataFrame:
    """(pk, LOAD_DATETIME, _kv_set): the latest set of each parent among rows of a satellite."""
    members = rows.select(pk, LDTS, *[h.alias(n) for n, h in zip(MARKS, _marks(cdk, hashdiff), strict=True)]).distinct()  # narrower than what they are of
    return _last_sets(members.groupBy(pk, LDTS).agg(_print_of(*[F.col(n) for n in MARKS]).alias("_kv_set")), pk)


def _last_sets(sets: DataFrame, pk: str) -> DataFrame:
    return sets.groupBy(pk).agg(F.max(LDTS).alias("_kv_ldts"), F.max_by("_kv_set", LDTS).alias("_kv_set")).withColumnRenamed("_kv_ldts", LDTS)


def late_sets(stage: DataFrame | Staged, target: DataFrame, pk: str, cdk: Sequence[str], hashdiff: str, target_rows: int | None = None) -> DataFrame:
    """Staged rows of sets that ``load_ma_sat`` keeps out: older than the target's latest set of their
    parent, or as old and not the same set. For quarantine. A ``Staged`` is exchanged before its hashes are
    made, into parts by its number of rows, as ``load_ma_sat`` does; ``target_rows`` is as there."""
    staged = isinstance(stage, Staged)
    rows = lying = (stage.rows() if staged else stage).where(F.col(pk).isNotNull())
    columns = rows.columns
    hot, n, _ = _cells(rows, pk)
    parts = _parts(rows.sparkSession, n) if staged else None
    if staged:
        lying = stage.rows(pk, parts).where(F.col(pk).isNotNull())
    known = set_marks(_wanted(target, lying, pk, parts is not None, n, target_rows), pk, cdk, hashdiff).select(F.col(pk).alias("_kv_pk"), F.col(LDTS).alias("_kv_ldts"), F.col("_kv_set").alias("_kv_known"))
    late = (F.col(LDTS) < F.col("_kv_ldts")) | ((F.col(LDTS) == F.col("_kv_ldts")) & (F.col("_kv_set") != F.col("_kv_known")))

    def by_parent(rows: DataFrame) -> DataFrame:
        both = (rows, _looked_up(known, parts is not None)) if staged else (_pack(rows, [pk], True).repartition(pk), _pack(known, ["_kv_pk"], True))
        met = both[0].join(both[1], F.col(pk) == F.col("_kv_pk")).where(F.col(LDTS) <= F.col("_kv_ldts"))
        one = F.row_number().over(Window.partitionBy(pk, LDTS, *cdk, hashdiff).orderBy(pk))
        own = Window.partitionBy(pk, LDTS)
        marked = met.withColumn("_kv_n", one).withColumn("_kv_set", _print(cdk, hashdiff, lambda c: c.over(own), F.col("_kv_n") == 1))
        out = marked.where(late).select(*columns)
        return out if staged else _unpack(out, [pk], rows, True)

    def spread(rows: DataFrame) -> DataFrame:
        sets = _sets(rows.select(pk, *cdk, hashdiff, LDTS).distinct(), pk, cdk, hashdiff)
        kept_out = sets.join(known, F.col(pk) == F.col("_kv_pk")).where(late).select(pk, LDTS)
        return rows.join(kept_out, [pk, LDTS], "left_semi").select(*columns)

    return _apart(rows, pk, by_parent, spread, hot, lying)


def high_date(df: DataFrame) -> Column:
    """The end of an open relationship, with the type of the start dates (with or without time zone)."""
    return F.lit(HIGH_DATE).cast(df.schema["START_DATE"].dataType)


def current_effectivity(target: DataFrame, pk: str) -> DataFrame:
    """The latest record of each relationship by load time; of one load time, the open one."""
    end = "END_DATE"
    others = [c for c in target.columns if c not in (pk, LDTS, end)]
    last = F.max(F.struct(LDTS, end, *others)).alias("x")
    return target.groupBy(pk).agg(last).select(pk, *[F.col(f"x.{c}").alias(c) for c in (LDTS, end, *others)])


def _effectivity(batch: DataFrame, current: DataFrame, pk: str, dfk: Sequence[str], sfk: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(begins, closed): relationships of a batch that aren't open, those that start before one that is gone
    with ``_kv_bad``; and open ones of its driving keys that it lacks, with the earliest start, the load
    time and the source of what follows them.

    ``current`` has the open relationships of the batch's driving keys. What goes on is left out first,
    and driving keys meet by aggregates and joins, so one with many relationships is spread."""
    values = [pk, *dfk, *sfk, "START_DATE", LDTS, SOURCE]
    opened = _first(batch, pk, [*dfk, *sfk, "START_DATE"]).select(F.col(pk).alias("_kv_n"), F.struct(*values).alias("n"))
    current = current.select(F.col(pk).alias("_kv_c"), F.struct(*values).alias("c"))
    met = opened.join(current, F.col("_kv_n") == F.col("_kv_c"), "full_outer").where("_kv_n IS NULL OR _kv_c IS NULL")
    met = written(met.select(F.col("_kv_c").isNull().alias("_kv_begins"), F.coalesce("n", "c").alias("x")).select("_kv_begins", F.struct(*[f"x.{c}" for c in dfk]).alias("_kv_key"), "x.*"), "met")
    begins, gone = met.where("_kv_begins").drop("_kv_begins"), met.where("NOT _kv_begins").drop("_kv_begins")
    ended = gone.groupBy("_kv_key").agg(F.max("START_DATE").alias("_kv_open"))
    begins = begins.join(ended, "_kv_key", "left").withColumn("_kv_bad", F.coalesce(F.col("START_DATE") < F.col("_kv_open"), F.lit(False)))
    follows = begins.where("NOT _kv_bad").groupBy("_kv_key").agg(F.min("START_DATE").alias("END_DATE"), F.max(LDTS).alias("_kv_ldts"), F.min(SOURCE).alias("_kv_source")).where("END_DATE IS NOT NULL")
    closed = gone.drop(LDTS, SOURCE).join(follows, "_kv_key").withColumnsRenamed({"_kv_ldts": LDTS, "_kv_source": SOURCE})
    return begins.select(*values, "_kv_bad"), closed.select(pk, *dfk, *sfk, "START_DATE", "END_DATE", LDTS, SOURCE)


def _open_of_batch(batch: DataFrame, target: DataFrame, pk: str, dfk: Sequence[str]) -> DataFrame:
    return current_effectivity(_of_batch(target, batch, dfk), pk).where(F.col("END_DATE") == high_date(target))


def load_eff_sat(batch: DataFrame, target: DataFrame | None, pk: str, dfk: Sequence[str], sfk: Sequence[str], current: DataFrame | None = None) -> DataFrame:
    """Effectivity from one snapshot batch (pk, dfk, sfk, START_DATE, LOAD_DATETIME, RECORD_SOURCE).

    Relationships that aren't open are opened. For the driving keys of the batch, open relationships
    that it doesn't hold get a closing record that ends with the earliest start among the new ones.
    A driving key may have several columns and nulls. Rows that start before what they would close
    are left out and close nothing: see ``rejected_effectivity``. ``current`` may have the open
    relationships of the batch's driving keys, where they are kept apart from the target."""
    columns = [pk, *dfk, *sfk, "START_DATE", "END_DATE", LDTS, SOURCE]
    if target is None and current is None:
        return _first(batch, pk, [*dfk, *sfk, "START_DATE"]).withColumn("END_DATE", high_date(batch)).select(*columns)
    begins, closed = _effectivity(batch, _open_of_batch(batch, target, pk, dfk) if current is None else current, pk, dfk, sfk)
    return begins.where("NOT _kv_bad").withColumn("END_DATE", high_date(batch)).select(*columns).unionByName(closed)


def rejected_effectivity(batch: DataFrame, target: DataFrame, pk: str, dfk: Sequence[str], sfk: Sequence[str]) -> DataFrame:
    """New relationships of a batch that start before an open one of their driving key that is gone."""
    return _effectivity(batch, _open_of_batch(batch, target, pk, dfk), pk, dfk, sfk)[0].where("_kv_bad").drop("_kv_bad")


def eff_sat_from_history(history: DataFrame, pk: str, dfk: Sequence[str], sfk: Sequence[str]) -> DataFrame:
    """Effectivity from all snapshots of a history at once: what ``load_eff_sat`` gives when it takes the
    snapshots (rows of one load time) one after another. A driving key may have any number of
    relationships in a snapshot, which may end, return and leave gaps.

    A snapshot changes a driving key's open relationships only if it holds one that is not open; all
    that it lacks are then closed. So after a change the open ones are those of that snapshot, and the
    next change is the first later snapshot that holds one it lacked. That one begins a run of
    snapshots after its last run had ended before the change: of each snapshot the earliest such end
    is all that the search needs, so a driving key brings one small row a snapshot, however many
    relationships it has. What lies between changes is left out, and runs over the changes are the
    records.

    Driving keys for which a relationship starts before one that it would close, or without a date,
    are loaded snapshot by snapshot, since such rows are left out there and this decides what
    later ones meet."""
    columns = [pk, *dfk, *sfk, "START_DATE", "END_DATE", LDTS, SOURCE]
    values = [SOURCE, *dfk, *sfk, "START_DATE"]
    rows = history.groupBy(pk, LDTS).agg(F.min(F.struct(*values)).alias("x")).select(pk, LDTS, *[F.col(f"x.{c}").alias(c) for c in values])
    rows = written(rows.withColumn("_kv_key", F.struct(*dfk)), "history")
    snapshots = rows.select("_kv_key", LDTS).distinct()
    numbered = snapshots.withColumn("_kv_t", F.row_number().over(Window.partitionBy("_kv_key").orderBy(LDTS)))  # a row a snapshot
    own = Window.partitionBy(pk)
    last = F.coalesce(F.lag("_kv_t").over(own.orderBy("_kv_t")), F.lit(0))
    begun = rows.select(pk, "_kv_key", LDTS).join(numbered, ["_kv_key", LDTS]).withColumn("_kv_last", last).where("_kv_last < _kv_t - 1 OR _kv_last = 0")
    begun = begun.groupBy("_kv_key", "_kv_t", LDTS).agg(F.min("_kv_last").alias("_kv_last"))
    steps = begun.groupBy("_kv_key").agg(F.sort_array(F.collect_list(F.struct("_kv_t", "_kv_last", LDTS))).alias("s"))
    none = F.array().cast(rows.select(F.array(LDTS)).schema[0].dataType)
    zero = F.struct(F.lit(0).alias("t"), none.alias("at"))
    changed = F.aggregate("s", zero, lambda z, x: F.when((z["t"] == 0) | (x["_kv_last"] < z["t"]), F.struct(x["_kv_t"].alias("t"), F.array_append(z["at"], x[LDTS]).alias("at"))).otherwise(z))
    changes = steps.select("_kv_key", F.posexplode(changed["at"]).alias("_kv_k", LDTS))
    at = rows.join(changes, ["_kv_key", LDTS])
    first = F.coalesce(F.col("_kv_k") - F.lag("_kv_k").over(own.orderBy("_kv_k")), F.lit(2)) > 1
    runs = at.withColumn("_kv_first", first).withColumn("_kv_run", F.sum(F.col("_kv_first").cast("int")).over(own.orderBy("_kv_k")))
    runs = runs.groupBy("_kv_key", pk, "_kv_run").agg(F.min(F.struct("_kv_k", LDTS, *values)).alias("x"), F.max("_kv_k").alias("_kv_end"))
    runs = written(runs.select("_kv_key", pk, "_kv_end", "x.*"), "runs")
    begins = runs.where("_kv_k > 0")
    ends = begins.groupBy("_kv_key", (F.col("_kv_k") - 1).alias("_kv_end")).agg(F.min("START_DATE").alias("_kv_start"), F.max(LDTS).alias("_kv_ldts"), F.min(SOURCE).alias("_kv_source"))
    opened = runs.withColumn("END_DATE", high_date(history)).select("_kv_key", *columns)
    closed = runs.join(ends, ["_kv_key", "_kv_end"]).select("_kv_key", pk, *dfk, *sfk, "START_DATE", F.col("_kv_start").alias("END_DATE"), F.col("_kv_ldts").alias(LDTS), F.col("_kv_source").alias(SOURCE))
    out = opened.unionByName(closed)

    gone = runs.groupBy("_kv_key", (F.col("_kv_end") + 1).alias("_kv_k")).agg(F.max("START_DATE").alias("_kv_gone"))
    early = begins.join(gone, ["_kv_key", "_kv_k"]).where(F.col("START_DATE") < F.col("_kv_gone")).select("_kv_key")
    apart = written(early.unionByName(rows.where("START_DATE IS NULL").select("_kv_key")).distinct(), "apart")
    if apart.isEmpty():
        return out.drop("_kv_key")
    single = written(rows.join(apart, "_kv_key", "left_semi").drop("_kv_key"), "single")
    records = written(out.join(apart, "_kv_key", "left_anti").drop("_kv_key"), "records")
    path, target = f"{shared_folder(history.sparkSession)}/records", None
    for (ldts,) in single.select(LDTS).distinct().orderBy(LDTS).collect():  # one round a snapshot
        new = load_eff_sat(single.where(F.col(LDTS) == F.lit(ldts)), target, pk, dfk, sfk)
        new.write.mode("append").parquet(path)
        target = history.sparkSession.read.schema(new.schema).parquet(path)
    return records.unionByName(target)


def load_fk_link(stage: DataFrame, target: DataFrame | None, pk: str, own_hk: str, own_key: str, hub_key: str, fk_column: str) -> DataFrame:
    """The link that a ratified foreign key names: the key is aliased to the hub's name before hashing."""
    fk = f"{hub_key}_HK".upper()
    rows = alias_fk(stage, hub_key, fk_column).withColumn(own_hk, hash_key([own_key])).withColumn(pk, hash_key([own_key, hub_key]))
    return load_link(rows, target, pk, [own_hk, fk], keys=[own_key, hub_key])
