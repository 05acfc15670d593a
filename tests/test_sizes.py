"""What loads exchange and write, and forms for hot parents, against the plain forms."""

import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_scale import equal, on_day, satellite_rows

from keelvault.functions.hashing import hash_key, packed, unpacked
from keelvault.operators import contract, integrity, load, match
from keelvault.operators.stage import Staged, StageSpec
from keelvault.plans.spec import Link, Satellite, VaultSpec, buckets_for, load_bucketed_vault
from keelvault.queries import build, checks

ARGS = ("HK", ["CHILD"], "HASHDIFF")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packed_keys(spark):
    """Hash keys take half their length; other texts come back as they were, and no two are alike."""
    texts = ["", "x", "a" * 32, "A" * 32, "g" * 32, "0" * 15, "0" * 31, "\x00" * 16, "é" * 16, "0123456789abcdef" * 2, None]
    df = spark.createDataFrame([(t,) for t in texts], "k string").withColumn("p", packed("k"))
    assert all(r.k == r.u for r in df.select("k", unpacked("p").alias("u")).collect())
    assert df.select("p").distinct().count() == len(texts)
    assert df.where("k RLIKE '^[0-9a-f]{32}$' AND length(p) <> 17").count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_sets_are_exchanged_once(spark, monkeypatch, hot):
    """Rows of sets are exchanged by parent once; hot parents are spread, with the same result."""
    rows = satellite_rows(spark)
    rows = rows.unionByName(rows.where("V = 1"))
    plain = load.load_ma_sat(rows, None, *ARGS, ["V"])
    assert plan(plain).count("Exchange hashpartitioning") == 1
    first, late = on_day(rows, 2), rows.where("LOAD_DATETIME < CAST('2026-01-04' AS timestamp)").withColumn("HASHDIFF", F.when(F.col("CHILD") == 1, "z").otherwise(F.col("HASHDIFF")))
    results = [plain.collect(), load.late_sets(late, plain, *ARGS).collect(), load.load_ma_sat(rows, first, *ARGS, ["V"]).collect()]
    assert all(results)
    if hot:
        monkeypatch.setattr(load, "HOT_ROWS", 15)
        monkeypatch.setattr(load, "HOT_TIMES", 0)
        assert 0 < len(load._hot(rows, "HK")) < 40
        again = [load.load_ma_sat(rows, None, *ARGS, ["V"]), load.late_sets(late, plain, *ARGS), load.load_ma_sat(rows, first, *ARGS, ["V"])]
        assert [sorted(df.collect()) for df in again] == [sorted(r) for r in results]


def test_repeated_rows_of_a_set_count_once(spark):
    rows = satellite_rows(spark)
    one = load.load_ma_sat(rows, None, *ARGS, ["V"])
    assert equal(one, load.load_ma_sat(rows.unionByName(rows), None, *ARGS, ["V"]))
    assert load.late_sets(on_day(rows, 6).unionByName(on_day(rows, 6)), rows, *ARGS).count() == 0


def test_narrow_rows_are_spread_before_they_are_made_wide(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(checks, "WIDE_ROWS", 20)
    monkeypatch.setattr(checks.integrity, "duplicate_columns", lambda df, *a: seen.append(df.rdd.getNumPartitions()))
    checks.v13_wide(spark, SF)
    assert seen[0] > 4


def test_text_of_another_type_is_not_parsed(spark):
    """Guards keep all that a type reads and save the parse of other text."""
    texts = ["1", " 1.5 ", "+1", "-.5", "5.", "1e5", "1E-5", "1.2e+3", "\t7\n", "٣٤", "1e", "e", "--1", "1-2", "", " ", "x", "2024-01-01", "2024-01-01 10:00:00", "1,5", "NaN", "Infinity", "1d", "0x1", "TRUE", " yes", "n", "F\n", "0", "truest", "+", "9" * 30, "\x017\x7f", "\u00a07", "\u2003true", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind, words in (("boolean", {"x", "2024-01-01", "truest", "1.2e+3"}), ("integer", {"x", " 1.5 ", "2024-01-01", "1e5"}), ("number", {"x", "2024-01-01", "2024-01-01 10:00:00", "1,5", "NaN"})):
        rows = df.select("t", contract.read_as(F.col("t"), kind).alias("a"), F.col("t").try_cast(contract.PHYSICAL[kind]).alias("b"), F.col("t").rlike(contract.MAY_BE[kind]).alias("may")).collect()
        assert all(r.a == r.b for r in rows) and any(r.a is not None for r in rows)
        assert not any(r.may for r in rows if r.t in words)


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning")


def test_staged_rows_are_exchanged_before_they_are_hashed(spark):
    """No hash crosses the exchange, loads by its key need no other, and results are those of plain stages."""
    staged = build.line_staged(spark, SF).where("LOAD_DATETIME < '1999-01-01'")
    args = ("LINE_HK", ["ORDER_HK", "PART_HK", "SUPPLIER_HK"], ["QUANTITY", "PRICE"], "SHIPPED")
    link, plain = load.load_t_link(staged.rows("LINE_HK", 4), None, *args), load.load_t_link(staged.rows(), None, *args)
    again = link.repartition(4, "LINE_HK")
    assert exchanges(again) == 1 and plan(again).index("ORDER_HK") < plan(again).index("Exchange hashpartitioning")
    assert equal(link, plain)
    sets = build.multi_active_staged(spark, SF)
    args = ("ORDER_HK", ["l_linenumber", "l_partkey", "l_suppkey"], "HASHDIFF", ["QUANTITY"])
    assert exchanges(load.load_ma_sat(sets, None, *args, parts=4).repartition(4, "ORDER_HK")) == 1
    assert equal(load.load_ma_sat(sets, None, *args), load.load_ma_sat(sets.rows(), None, *args))


def test_tasks_are_sized_by_rows(spark, monkeypatch):
    """Many rows are dealt into parts by their number, whatever few bytes of them cross the exchange."""
    sets = build.multi_active_staged(spark, SF)
    args = ("ORDER_HK", ["l_linenumber", "l_partkey", "l_suppkey"], "HASHDIFF", ["QUANTITY"])
    held = load.load_ma_sat(sets.where("LOAD_DATETIME < '2002-01-15'"), None, *args)
    cores = spark.sparkContext.defaultParallelism
    n = sets.rows().count()
    monkeypatch.setattr(load, "TASK_ROWS", n // (3 * cores))
    for target in (None, held):
        many = load.load_ma_sat(sets, target, *args)
        assert f"{-(-n // load.TASK_ROWS)}), REPARTITION_BY_NUM" in plan(many)
        largest = many.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert largest < 3 * load.TASK_ROWS
    monkeypatch.setattr(load, "TASK_ROWS", 1 << 19)
    few = load.load_ma_sat(sets, held, *args)
    assert "REPARTITION_BY_NUM" not in plan(few) and equal(few, many) and few.count() > 0
    assert load.load_ma_sat(sets.where("l_orderkey < 0"), held, *args).count() == 0


def test_staged_rows_with_keys_to_clean(spark):
    """Blank, padded and null keys, and those with marks, lie where their hash keys say."""
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(["a", " A ", "", " ", None, "b|", "^^", "\\", "b"] * 3)], "k string, v int").withColumn("at", F.lit("2026-01-01").cast("timestamp"))
    staged = Staged(rows, StageSpec(derived={"ID": "k"}, keys={"HK": ["ID"]}, diffs={"HASHDIFF": ["v"]}, ldts="at", source="x"))
    one = staged.rows("HK", 4)
    assert equal(one, staged.rows())
    assert exchanges(one.groupBy("HK").count()) == 1
    assert {r.HK for r in one.groupBy("HK").count().where("`count` % 3 = 0").collect()} == {r.HK for r in staged.rows().select("HK").distinct().collect()}


def test_bucketed_tables_are_met_where_rows_lie(spark, monkeypatch):
    """A second batch of a bucketed vault exchanges the rows of its stages only, once for each use."""
    spark.sql("CREATE DATABASE staged")
    spec = VaultSpec(links=[Link("t_line", "lines", "LINE_HK", ["ORDER_HK"], event_time="SHIPPED", payload=["QUANTITY"])], satellites=[Satellite("sat_lines", "sets", "ORDER_HK", payload=["QUANTITY"], kind="multi_active", child_keys=["l_linenumber", "l_partkey", "l_suppkey"])])
    stages = {"lines": build.line_staged(spark, SF), "sets": build.multi_active_staged(spark, SF)}
    load_bucketed_vault(spark, spec, {"lines": stages["lines"].where("l_orderkey % 2 = 0"), "sets": stages["sets"].where("LOAD_DATETIME < '2002-01-15'")}, "staged", 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        line = load.load_t_link(stages["lines"].rows("LINE_HK", 4), spark.table("staged.t_line"), "LINE_HK", ["ORDER_HK"], ["QUANTITY"], "SHIPPED").repartition(4, "LINE_HK")
        sets = load.load_ma_sat(stages["sets"], spark.table("staged.sat_lines"), "ORDER_HK", ["l_linenumber", "l_partkey", "l_suppkey"], "HASHDIFF", ["QUANTITY"], parts=4).repartition(4, "ORDER_HK")
        assert (exchanges(line), exchanges(sets)) == (1, 2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_integrity_checks_exchange_narrow_keys(spark):
    """Checks that only tell keys apart exchange them as bytes, or source values before keys are made."""
    lines, args = build.multi_active_staged(spark, SF), ("lines", "ORDER_HK", ["l_linenumber"])
    staged, plain = integrity.cdk_unique(lines, *args), integrity.cdk_unique(lines.rows(), *args)
    assert exchanges(staged) == 1 and "Exchange hashpartitioning(ORDER_HK" not in plan(staged)
    assert staged.collect() == plain.collect()
    for df in (plain, integrity.parent_grain(lines.rows(), "lines", "ORDER_HK"), integrity.txn_events(build.line_stage(spark, SF), "lines", "ORDER_HK", "SHIPPED")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("unhex(") > 0


def test_texts_are_split_once_for_their_tokens(spark):
    """Pairs are those of the tokens, and the plan of the pairs holds no text of the larger side."""
    texts = ["one two three four", "ONE-two, Three  the of", "straße ıx ﬁne one_two", "", " ,", "a b c", None, "two Two TWO one three", "four five\nsix"]
    a = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, long_text string")
    b = spark.createDataFrame([(i, t) for i, t in enumerate(reversed(texts))], "j int, t string")
    sets = {t: set(r) for t, r in b.select("t", match.tokens("t", 2, match.STOP_TOKENS)).collect() if r is not None}
    for least in (1, 2, 3):
        got = match.match_tokens(a, b, "i", "long_text", "j", "t", least=least)
        assert "long_text" not in plan(got)
        want = {(i, j, len(sets[x] & sets[y])) for i, x in enumerate(texts) for j, y in enumerate(reversed(texts)) if x is not None and y is not None and len(sets[x] & sets[y]) >= least}
        assert want and {tuple(r) for r in got.collect()} == want


def test_numbers_and_dates_are_hashed_without_cleaning(spark):
    """Keys are those of the cleaned text, whatever the types, and the plan cleans text only."""
    rows = [(-5, 2**40, "-0.50", "1.5", " a|b ", "2024-01-05", True), (0, -1, "0.00", "NaN", "^^", "0001-01-01", False), (7, 10**18, "12345678901234567.89", "-0.0", "", "9999-12-31", None), (None,) * 7]
    df = spark.createDataFrame(rows, "i int, l long, d string, x string, t string, a string, b boolean").selectExpr("i", "l", "CAST(l % 100 AS smallint) AS s", "CAST(d AS decimal(20,2)) AS d", "CAST(d AS decimal(38,18)) AS e", "CAST(x AS double) AS x", "t", "CAST(a AS date) AS a", "CAST(a AS timestamp) AS at", "b")
    for cols in [[c] for c in df.columns] + [df.columns, [F.col("d") + 1, "t"]]:
        both = df.select(hash_key(cols).alias("plain"), hash_key(cols, df).alias("typed"))
        assert all(r.plain == r.typed for r in both.collect())
    assert "upper(" not in plan(df.select(hash_key(["i", "l", "s", "d", "a"], df))) and "upper(" in plan(df.select(hash_key(["b"], df)))


def test_marks_of_sets_stay_as_they_are(spark):
    """Marks are kept in head tables: sums of halves give what sums of whole hashes gave."""
    rows = satellite_rows(spark)
    values = [F.col("CHILD"), F.col("CHILD").isNull(), F.col("HASHDIFF")]
    sums = [F.sum(F.xxhash64(F.lit(i), *values).cast("decimal(20,0)")).cast("string") for i in (1, 2)]
    old = rows.groupBy("HK", "LOAD_DATETIME").agg(F.unhex(F.md5(F.concat_ws(",", F.count("*").cast("string"), *sums).cast("binary"))).alias("_kv_set"))
    assert equal(load._sets(rows, *ARGS), old)
    last = old.groupBy("HK").agg(F.max("LOAD_DATETIME").alias("LOAD_DATETIME"), F.max_by("_kv_set", "LOAD_DATETIME").alias("_kv_set"))
    assert equal(load.set_marks(rows.unionByName(rows), *ARGS), last)


def test_sets_of_one_load_time(spark, monkeypatch):
    """A batch of one load time needs no look at the set before within the batch, with the same result."""
    rows = satellite_rows(spark)
    rows, first = rows.unionByName(rows.where("V = 1")), load.load_ma_sat(on_day(rows, 2), None, *ARGS, ["V"])
    batch = rows.where("LOAD_DATETIME = CAST('2026-01-04' AS timestamp)")
    short = [load.load_ma_sat(batch, t, *ARGS, ["V"]) for t in (None, first)]
    cells = load._cells
    monkeypatch.setattr(load, "_cells", lambda *a: (*cells(*a)[:2], False))
    whole = [load.load_ma_sat(batch, t, *ARGS, ["V"]) for t in (None, first)]
    for a, b in zip(short, whole, strict=True):
        assert equal(a, b) and 0 < a.count() and plan(a).count("lag(") == 0 < plan(b).count("lag(")
    assert short[1].count() < short[0].count()
    assert not cells(rows, "HK")[2] and not cells(batch.withColumn("LOAD_DATETIME", F.when(F.col("V") > 1, F.col("LOAD_DATETIME"))), "HK")[2] and not cells(batch.limit(0), "HK")[2]


def test_known_events_are_left_out_before_they_are_hashed(spark):
    """Of a repeated batch only the key is hashed; ties and repeated events count as in the plain form."""
    lines = build.line_staged(spark, SF)
    lines = Staged(lines.df.unionByName(lines.df.withColumn("l_quantity", F.col("l_quantity") + F.col("l_linenumber") % 3)), lines.spec)
    args = ("LINE_HK", ["ORDER_HK", "PART_HK", "SUPPLIER_HK"], ["QUANTITY", "PRICE"], "SHIPPED")
    held = load.load_t_link(lines.where("LOAD_DATETIME < '1998-01-01'").rows(), None, *args)
    held.write.saveAsTable("held_lines")
    held = spark.table("held_lines")
    for target in (None, held):
        new = load.load_t_link(lines, target, *args, parts=4)
        assert equal(new, load.load_t_link(lines.rows(), target, *args)) and new.count() > 0
    below = plan(new).split("LeftAnti")[1]
    assert "AS LINE_HK" in below and "AS ORDER_HK" not in below and "AS PART_HK" not in below
    assert load.load_t_link(lines.where("LOAD_DATETIME < '1998-01-01'"), held, *args, parts=4).count() == 0
    own = Staged(lines.df.withColumn("LINE_HK", F.md5(F.col("l_orderkey").cast("string"))), lines.spec)  # the source's own column wins
    assert equal(load.load_t_link(own, held, *args, parts=4), load.load_t_link(own.rows(), held, *args))


def test_buckets_follow_the_rows(spark, monkeypatch):
    """Tables get buckets by what they will hold, each its own number, with the same rows."""
    assert (buckets_for(0), buckets_for(8 << 19), buckets_for((8 << 19) + 1), buckets_for(216_000_000)) == (8, 8, 9, 412)
    lines, sets = build.line_staged(spark, SF), build.multi_active_staged(spark, SF)
    spec = VaultSpec(links=[Link("t_line", "lines", "LINE_HK", ["ORDER_HK"], event_time="SHIPPED", payload=["QUANTITY"])], satellites=[Satellite("sat_lines", "sets", "ORDER_HK", payload=["QUANTITY"], kind="multi_active", child_keys=["l_linenumber", "l_partkey", "l_suppkey"])])
    found = []
    for name, buckets in (("apart", {"t_line": 5, "sat_lines": 3}), ("alike", 4)):
        spark.sql(f"CREATE DATABASE {name}")
        for batch in (sets.where("LOAD_DATETIME < '2002-01-15'"), sets.where("LOAD_DATETIME > '2002-01-15'")):
            load_bucketed_vault(spark, spec, {"lines": lines, "sets": batch}, name, buckets)
        found.append([spark.table(f"{name}.{t}") for t in ("t_line", "sat_lines")])
        has = [spark.sql(f"DESCRIBE EXTENDED {name}.{t}").where("col_name = 'Num Buckets'").first().data_type for t in ("t_line", "sat_lines")]
        assert has == (["5", "3"] if name == "apart" else ["4", "4"])
    assert all(equal(a, b) for a, b in zip(*found, strict=True))

    class Stop(Exception):
        pass

    def stop(*args):
        found.append(args[-1])
        raise Stop

    monkeypatch.setattr(build, "load_bucketed_vault", stop)
    monkeypatch.setattr(load, "TASK_ROWS", 500)
    with pytest.raises(Stop):
        build.l15_parts(spark, SF)
    assert found[-1]["t_line"] == found[-1]["sat_lines"] == -(-lines.df.count() // 500) > 8 and found[-1]["hub_customer"] == 8


def test_late_sets_are_exchanged_before_they_are_hashed(spark, monkeypatch):
    """Staged rows cross the exchange without hashes, into parts by their number, and give what plain rows give."""
    sets, args = build.multi_active_staged(spark, SF), ("ORDER_HK", ["l_linenumber", "l_partkey", "l_suppkey"], "HASHDIFF")
    other = sets.then(lambda df: df.withColumn("HASHDIFF", F.when(F.col("l_orderkey") % 30 == 0, F.md5("HASHDIFF")).otherwise(F.col("HASHDIFF"))))
    held = load.load_ma_sat(sets, None, *args, ["QUANTITY"])
    plain = load.late_sets(other.rows(), held, *args)
    few = load.late_sets(other, held, *args)
    monkeypatch.setattr(load, "TASK_ROWS", 500)
    many = load.late_sets(other, load.load_ma_sat(sets, None, *args, ["QUANTITY"]), *args)
    assert "unhex(ORDER_HK" not in plan(many) and "REPARTITION_BY_NUM" in plan(many) and "Exchange hashpartitioning(ORDER_HK" not in plan(many)
    assert few.columns == plain.columns and equal(few, plain) and equal(many, plain) and plain.count() > 0
    assert load.late_sets(other.where("l_orderkey < 0"), held, *args).count() == 0
    monkeypatch.setattr(load, "HOT_ROWS", 10)
    monkeypatch.setattr(load, "HOT_TIMES", 0)
    assert load._hot(other.rows(), "ORDER_HK") and equal(load.late_sets(other, held, *args), plain)


def test_keys_are_not_made_again_to_tell_nulls_apart(spark):
    """Joins by keys that cross an exchange as bytes add no filter with the hash in it again and again."""
    rows, args = build.multi_active(spark, SF), ("ORDER_HK", ["l_linenumber", "l_partkey", "l_suppkey"], "HASHDIFF")
    held = load.load_ma_sat(rows, None, *args, ["QUANTITY"])
    marks = load.set_marks(held, *args)
    for df in (load.late_sets(rows, held, *args), load.load_ma_sat(rows, None, *args, ["QUANTITY"], known=marks)):
        conditions = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
        assert conditions and not [c for c in conditions if "concat_ws(||" in c]  # marks of sets have commas
    nulls = rows.withColumn("ORDER_HK", F.when(F.col("l_orderkey") % 3 > 0, F.col("ORDER_HK")))
    keyed = rows.where("l_orderkey % 3 > 0")
    assert equal(load.load_ma_sat(nulls, None, *args, ["QUANTITY"]), load.load_ma_sat(keyed, None, *args, ["QUANTITY"]))
    assert equal(load.late_sets(nulls, held, *args), load.late_sets(keyed, held, *args))


def test_targets_like_the_batch_are_marked_as_a_whole(spark):
    """A target that isn't much larger than the batch needs no search for the batch's parents, with the same result."""
    rows = satellite_rows(spark)
    first = load.load_ma_sat(on_day(rows, 2), None, *ARGS, ["V"])
    n, some = first.count(), rows.where("HK IN ('k1', 'k2', 'k3')")
    late = on_day(some, 2).withColumn("HASHDIFF", F.when(F.col("CHILD") == 1, "z").otherwise(F.col("HASHDIFF")))
    assert some.count() * load.WHOLE < 4 * n and 0 < n <= load.WHOLE * rows.count()
    for batch, held in ((rows, n), (some, 4 * n), (some, 0)):
        whole, found = (load.load_ma_sat(batch, first, *ARGS, ["V"], target_rows=r) for r in (held, None))
        assert ("LeftSemi" in plan(whole)) == (held > load.WHOLE * batch.count()) and "LeftSemi" in plan(found)
        assert equal(whole, found) and whole.count() > 0
    kept_out = load.late_sets(late, first, *ARGS, target_rows=0)
    assert equal(kept_out, load.late_sets(late, first, *ARGS)) and kept_out.count() > 0 and "LeftSemi" not in plan(kept_out)
