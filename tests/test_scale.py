"""Forms of operators for wide and large tables, against the plain forms."""

import random
import shutil

import pytest

from keelvault.operators import extend, heads, integrity, load, match, profile
from keelvault.plans.spec import Hub, VaultSpec, compact_bucketed, load_bucketed_vault, run_batches
from keelvault.sources import feeds
from keelvault.sources.feeds import shared_folder


def test_many_columns_are_compared_in_linear_work(spark):
    """1,000 columns: equal ones are found whatever their number, nulls and types count."""
    n = 1000
    row = lambda r: [None if r % 3 == 0 and c % 10 == 4 else (r * 31 + c % 10) if c % 10 < 5 else r * 1000 + c for c in range(n)]
    df = spark.createDataFrame([row(r) for r in range(12)], ", ".join(f"c{i} long" for i in range(n)))
    got = {r.construct for r in integrity.duplicate_columns(df, "s", df.columns).collect()}
    want = {f"s.c{a}=c{b}" for k in range(5) for a in range(k, n, 10) for b in range(a + 10, n, 10)}
    assert got == want


def test_duplicate_columns_edges(spark):
    df = spark.createDataFrame([(1, 1, "1", None, None, 2), (2, 2, "2", None, None, 2)], "a long, b long, c string, d long, e long, `A-` long")
    got = {(r.construct, r.n_rows) for r in integrity.duplicate_columns(df, "s", ["a", "b", "c", "d", "e", "A-"]).collect()}
    assert got == {("s.a=b", 2), ("s.d=e", 2), ("s.a=A-", 1)}
    empty = {r.construct for r in integrity.duplicate_columns(df.limit(0), "s", ["a", "b", "A-"]).collect()}
    assert empty == {"s.a=A-"}
    assert integrity.duplicate_columns(df, "s", ["a"]).count() == 0


@pytest.mark.parametrize("batches", [1, 4])
def test_profile_by_batch(spark, batches):
    """A profile kept by batch is the one-pass profile, whatever the batches and partitions; a batch that
    is run again changes nothing; the sketch is near the exact profile."""
    rows = [(i, i % 700, float(i % 13) if i % 5 else None, f"v{i * i % 4001}", None) for i in range(9000)]
    df = spark.createDataFrame(rows, "id long, few long, x double, text string, nothing string")
    path = shared_folder(spark)
    for i in [*range(batches), 0]:
        profile.add_to_profile(df.where(f"id % {batches} = {i}").repartition(1 + i), path, f"b{i}")
    got = {r.column_name: r for r in profile.read_profile(spark, path).collect()}
    one = {r.column_name: r for r in profile.profile_of(profile.profile_sketches(df.coalesce(1))).collect()}
    exact = {r.column_name: r for r in profile.profile_columns(df).collect()}
    for c, r in got.items():
        assert (r.row_count, r.null_ratio, r.distinct_count, r.uniqueness_ratio) == (one[c].row_count, one[c].null_ratio, one[c].distinct_count, one[c].uniqueness_ratio)
        assert abs(r.distinct_count - exact[c].distinct_count) <= 0.06 * exact[c].distinct_count
        assert (r.row_count, round(r.null_ratio, 9)) == (exact[c].row_count, round(exact[c].null_ratio, 9))
    assert abs(got["id"].median - 4500) < 250 and got["text"].median is None and got["x"].high in (11.0, 12.0)
    assert (got["nothing"].distinct_count, got["nothing"].null_ratio) == (0, 1.0)


def test_empty_profile(spark):
    df = spark.createDataFrame([], "a long, b string")
    got = {r.column_name: r for r in profile.profile_of(profile.profile_sketches(df)).collect()}
    assert [(r.row_count, r.null_ratio, r.distinct_count, r.median) for r in got.values()] == [(0, 0.0, 0, None)] * 2


def column_values(spark, seed=5, columns=120):
    """Columns over a few domains: small integers that many share, subsets, supersets with gaps, own keys."""
    rng = random.Random(seed)
    rows = []
    for i in range(columns):
        kind = i % 4
        if kind == 0:
            values = range(rng.randint(1, 60))
        elif kind == 1:
            values = rng.sample(range(3000), rng.randint(100, 400))
        elif kind == 2:
            values = rng.sample(range(3000), rng.randint(2500, 3000))
        else:
            values = (f"{i}-{k}" for k in range(200))
        rows += [(f"t{i % 9}", f"c{i}", str(v)) for v in values]
    return spark.createDataFrame([*rows, ("t0", "c0", None)], "source string, column string, value string")


def test_columns_are_proposed_and_confirmed(spark):
    """All pairs above the limit, by comparison with the exact form over all pairs."""
    keys = column_values(spark)
    names = ["child_source", "child_column", "parent_source", "parent_column", "n_shared", "n_child"]
    full = {tuple(r) for r in match.column_containment(keys).select(*names).where("n_shared >= 0.9 * n_child").collect()}
    got = {tuple(r) for r in match.contained_columns(keys, 0.9).select(*names).collect()}
    assert got <= full and len(got) >= 0.999 * len(full) and len(full) > 500
    proposed = match.propose_containment(keys, 0.9).count()
    assert proposed < 1.5 * len(full)
    whole = {tuple(r) for r in match.contained_columns(keys, 1.0).select(*names).collect()}
    assert whole == {r for r in full if r[4] == r[5]}


def test_hash_tree_finds_changed_buckets(spark):
    """The same rows as the full join; one changed row leads to one bucket, which is all that is read."""
    rows = [(i, f"name {i}", None if i % 7 == 0 else i * 2) for i in range(3000)] + [(None, "no key", 1)]
    df = spark.createDataFrame(rows, "id long, name string, n long")
    paths = [shared_folder(spark) for _ in range(4)]
    extend.append_hashed(df, paths[0], ["id"])
    extend.append_hashed(df.where("id <> 77 OR id IS NULL"), paths[1], ["id"])
    extend.append_hashed(df.where("id = 77"), paths[1], ["id"])  # in a later load
    assert extend.differing_buckets(spark, *paths[:2]) == [] and extend.diff_hashed(spark, *paths[:2], ["id"]).count() == 0
    assert extend.preserved_hashed(spark, *paths[:2]).first().score == 1.0
    extend.append_hashed(df.selectExpr("id", "name", "IF(id = 77, -1, n) AS n"), paths[2], ["id"])
    assert len(extend.differing_buckets(spark, paths[0], paths[2])) == 1
    diff = extend.diff_hashed(spark, paths[0], paths[2], ["id"])
    assert [tuple(r) for r in diff.collect()] == [(77, "changed")]
    read = [line for line in diff._jdf.queryExecution().toString().splitlines() if "PartitionFilters" in line]
    assert read and all("_kv_bucket" in line.split("PartitionFilters: [")[1].split("]")[0] for line in read)
    changed = df.where("id % 50 <> 3").selectExpr("id", "IF(id % 50 = 4, 'x', name) AS name", "n").union(spark.createDataFrame([(9001, "new", 1)], df.schema))
    extend.append_hashed(changed, paths[3], ["id"])
    got = {tuple(r) for r in extend.diff_hashed(spark, paths[0], paths[3], ["id"]).collect()}
    full = {tuple(r) for r in extend.diff_tables(df, changed, ["id"]).where("status <> 'unchanged'").collect()}
    assert got == full and len(full) == 122 and (None, "removed") in full
    one, other = extend.preserved_hashed(spark, paths[0], paths[3]).first(), extend.preserved(df, changed).first()
    assert tuple(one) == tuple(other)


def satellite_rows(spark, seed=2, keys=40, days=6):
    rng = random.Random(seed)
    rows = []
    for day in range(1, days + 1):
        for k in range(keys):
            if rng.random() < 0.7:
                for child in range(rng.randint(1, 3)):
                    v = rng.randint(1, 3)
                    rows.append((f"k{k}", child, f"d{v}", v, f"2026-01-{day:02} 00:00:00"))
    df = spark.createDataFrame(rows, "HK string, CHILD int, HASHDIFF string, V int, at string")
    return df.selectExpr("HK", "CHILD", "HASHDIFF", "V", "CAST(at AS timestamp) AS LOAD_DATETIME", "'s' AS RECORD_SOURCE")


def equal(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def on_day(df, day):
    return df.where(f"LOAD_DATETIME = CAST('2026-01-{day:02}' AS timestamp)")


@pytest.mark.parametrize("kind", ["sat", "ma_sat", "eff_sat"])
def test_heads_stand_for_histories(spark, kind):
    """Loads by heads give what loads against the whole history give; a batch that was broken off between
    its two writes, or that comes again, adds nothing twice."""
    rows, path = satellite_rows(spark), shared_folder(spark)
    if kind == "eff_sat":
        rows = rows.where("CHILD = 0").selectExpr("concat(HK, HASHDIFF) AS HK", "IF(HK = 'k3', NULL, HK) AS A", "HASHDIFF AS B", "LOAD_DATETIME AS START_DATE", "LOAD_DATETIME", "RECORD_SOURCE")
    args = {"sat": ("HK", "HASHDIFF", ["V"]), "ma_sat": ("HK", ["CHILD"], "HASHDIFF", ["V"]), "eff_sat": ("HK", ["A"], ["B"])}[kind]
    plain, by_heads = getattr(load, f"load_{kind}"), getattr(heads, f"load_{kind}_with_heads")
    want = run_batches(rows, [f"2026-01-{d:02}" for d in range(2, 7)], lambda b, t: plain(b, t, *args))
    for day in range(1, 7):
        if day == 4:
            shutil.copytree(f"{path}/heads", f"{path}/before")
        new = by_heads(on_day(rows, day), path, f"b{day}", *args, buckets=8)
        assert new.count() > 0
        if day == 4:  # as if the heads had not been written
            shutil.rmtree(f"{path}/heads")
            shutil.move(f"{path}/before", f"{path}/heads")
            by_heads(on_day(rows, day), path, f"b{day}", *args, buckets=8)
    assert by_heads(on_day(rows, 6), path, "b6", *args, buckets=8).count() == 0
    assert equal(heads.read_history(spark, path), want)


def test_batches_read_heads_only(spark):
    """What a batch reads of what is stored does not grow with the number of earlier batches."""
    rows, path = satellite_rows(spark, keys=20), shared_folder(spark)
    sizes = []
    for day in range(1, 7):
        heads.load_sat_with_heads(on_day(rows, day).where("CHILD = 0"), path, f"b{day}", "HK", "HASHDIFF", ["V"], buckets=2)
        sizes.append(spark.read.parquet(f"{path}/heads").count())
    assert max(sizes) <= 20 < heads.read_history(spark, path).count()


def test_batches_are_partitions(spark):
    rows, path = satellite_rows(spark), shared_folder(spark)
    for day in (1, 2, 3):
        feeds.append_by_date(on_day(rows, day), path)
    one, rest = feeds.read_batch(spark, path, "2026-01-02"), feeds.read_batch(spark, path, since="2026-01-02")
    assert equal(on_day(rows, 2), one) and rest.count() == on_day(rows, 2).count() + on_day(rows, 3).count()
    for df in (one, rest):
        assert "LOAD_DATE" in str(df._jdf.queryExecution()).split("PartitionFilters: [")[1].split("]")[0]
    assert equal(feeds.read_batch(spark, path), rows.where("LOAD_DATETIME < CAST('2026-01-04' AS timestamp)"))


def test_compacted_tables_join_without_exchange_and_sort(spark):
    """After many loads a bucket is one sorted file again."""
    spec = VaultSpec(hubs=[Hub("hub_k", ["s"], "K_HK", "K")])
    spark.sql("CREATE DATABASE IF NOT EXISTS compacting")
    stage = spark.range(300).selectExpr("md5(CAST(id AS string)) AS K_HK", "id AS K", "CAST('2026-01-01' AS timestamp) AS LOAD_DATETIME", "'s' AS RECORD_SOURCE")
    for i in range(12):
        load_bucketed_vault(spark, spec, {"s": stage.where(f"K % 12 = {i}")}, "compacting", 4)
    table, before = "compacting.hub_k", spark.table("compacting.hub_k").inputFiles()
    compact_bucketed(spark, table, 4, "K_HK")
    compact_bucketed(spark, table, 4, "K_HK")
    assert len(before) > 12 and len(spark.table(table).inputFiles()) == 4 and equal(stage, spark.table(table))
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table(table).select("K_HK", "K").join(spark.table(table).select("K_HK", "LOAD_DATETIME"), "K_HK")
        assert joined.count() == 300
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort " not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    load_bucketed_vault(spark, spec, {"s": stage}, "compacting", 4)
    assert spark.table(table).count() == 300
    # A run that was broken off after the old table had gone aside is completed.
    spark.sql(f"ALTER TABLE {table} RENAME TO {table}_compacted")
    compact_bucketed(spark, table, 4, "K_HK")
    assert spark.table(table).count() == 300
