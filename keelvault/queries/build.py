"""Queries of sources, staging, loads and reads, each with the closed form of its result in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keelvault.functions.hashing import hash_key, hashdiff
from keelvault.functions.names import normalize_identifier
from keelvault.operators import heads, load, read, stage
from keelvault.plans.spec import Hub, Link, Satellite, VaultSpec, buckets_for, load_bucketed_vault, load_vault, run_batches
from keelvault.queries.base import HIGH, hashed, query, table
from keelvault.sources import feeds

CUTS = ["1997-01-01", "1999-01-01"]


def money(c: str):
    return F.col(c).cast("decimal(18,2)")


def orders_staged(spark, d):
    spec = stage.StageSpec(
        derived={"ORDER_ID": "o_orderkey", "CUSTOMER_ID": "o_custkey"},
        keys={"ORDER_HK": ["ORDER_ID"], "CUSTOMER_HK": ["CUSTOMER_ID"], "ORDER_CUSTOMER_HK": ["ORDER_ID", "CUSTOMER_ID"]},
        diffs={"HASHDIFF": ["o_orderstatus", money("o_totalprice"), "o_orderpriority"]},
        ldts="o_orderdate",
        source="orders",
    )
    return stage.Staged(table(spark, d, "orders"), spec)


def orders_stage(spark, d):
    return orders_staged(spark, d).rows()


def customer_stage(spark, d):
    spec = stage.StageSpec(
        derived={"CUSTOMER_ID": "c_custkey"},
        keys={"CUSTOMER_HK": ["CUSTOMER_ID"]},
        diffs={"HASHDIFF": ["c_name", "c_mktsegment", money("c_acctbal")]},
        ldts=F.lit("1996-06-01").cast("timestamp"),
        source="customer",
    )
    return stage.stage(table(spark, d, "customer"), spec)


def events_stage(spark, d):
    spec = stage.StageSpec(keys={"USER_HK": ["user_id"], "RELATION_HK": ["user_id", "event_type"], "TYPE_HK": ["event_type"]}, diffs={"HASHDIFF": ["event_type"]}, ldts="ts", source="events", derived={"START_DATE": "ts"})
    return stage.stage(table(spark, d, "events"), spec)


ORDERS = f"""o AS (SELECT *, o_orderkey AS ORDER_ID, o_custkey AS CUSTOMER_ID, {hashed('o_orderkey')} AS ORDER_HK, {hashed('o_custkey')} AS CUSTOMER_HK,
  {hashed('o_orderkey', 'o_custkey')} AS ORDER_CUSTOMER_HK, {hashed('o_orderstatus', 'CAST(o_totalprice AS DECIMAL(18,2))', 'o_orderpriority')} AS HASHDIFF, o_orderdate AS LOAD_DATETIME, 'orders' AS RECORD_SOURCE FROM orders)"""
CUSTOMERS = f"""c AS (SELECT *, c_custkey AS CUSTOMER_ID, {hashed('c_custkey')} AS CUSTOMER_HK, {hashed('c_name', 'c_mktsegment', 'CAST(c_acctbal AS DECIMAL(18,2))')} AS HASHDIFF,
  TIMESTAMP '1996-06-01 00:00:00' AS LOAD_DATETIME, 'customer' AS RECORD_SOURCE FROM customer)"""
EVENTS = f"""e AS (SELECT *, {hashed('user_id')} AS USER_HK, {hashed('user_id', 'event_type')} AS RELATION_HK, {hashed('event_type')} AS TYPE_HK, {hashed('event_type')} AS HASHDIFF, ts AS LOAD_DATETIME, 'events' AS RECORD_SOURCE FROM events)"""


# Sources and sinks


@query("s1_read_source", "SELECT l_returnflag, count(*) AS n_rows, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_returnflag")
def s1(spark, d):
    df, _ = feeds.read_source(spark, f"{d}/lineitem.parquet", {"l_returnflag": "unknown", "l_quantity": "number", "l_shipdate": "date-time", "l_orderkey": "integer"})
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n_rows"), F.sum("l_quantity").cast("double").alias("sum_qty"), F.min("l_shipdate").alias("first_ship"))


@query("s2_bind", "SELECT c_custkey AS CUSTOMER_ID, c_mktsegment AS SEGMENT FROM customer")
def s2(spark, d):
    return feeds.bind(table(spark, d, "customer"), {"CUSTOMER_ID": "c_custkey", "SEGMENT": "c_name"}, {"SEGMENT": "c_mktsegment"})


@query("s3_snapshot_batch", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate = TIMESTAMP '1996-01-02 00:00:00'")
def s3(spark, d):
    import datetime

    return feeds.snapshot_batch(table(spark, d, "orders"), datetime.datetime(1996, 1, 2), "o_orderdate").select("o_orderkey", "o_custkey")


@query("s3_read_batch", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate = TIMESTAMP '1996-01-02 00:00:00' UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-20 00:00:00'")
def s3_dated(spark, d):
    """Batches of a table that is laid out by load date (of one month): one of them, and all from a date on."""
    path = feeds.shared_folder(spark)
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("LOAD_DATETIME"))
    early = o.withColumn("LOAD_DATETIME", F.when(F.col("LOAD_DATETIME") >= "1996-02-01", F.lit("1996-02-01").cast("timestamp")).otherwise(F.col("LOAD_DATETIME")))
    feeds.append_by_date(early, path)
    batch, rest = feeds.read_batch(spark, path, "1996-01-02"), feeds.read_batch(spark, path, since="1996-01-20")
    return batch.unionByName(rest).drop("LOAD_DATETIME")


@query("s4_union_feeds", "SELECT feed, count(*) AS n_rows, count(DISTINCT k) AS n_keys FROM (SELECT 'customer' AS feed, c_custkey AS k FROM customer UNION ALL SELECT 'orders', o_custkey FROM orders) GROUP BY feed")
def s4(spark, d):
    frames = [table(spark, d, "customer").select(F.lit("customer").alias("feed"), F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit("orders").alias("feed"))]
    return feeds.union_feeds(frames).groupBy("feed").agg(F.count("*").alias("n_rows"), F.count_distinct("k").alias("n_keys"))


@query("s5_append_increment", f"WITH {ORDERS} SELECT CUSTOMER_HK, CUSTOMER_ID FROM o GROUP BY ALL")
def s5(spark, d):
    path = feeds.shared_folder(spark)
    hub = load.load_hub(orders_stage(spark, d), None, "CUSTOMER_HK", "CUSTOMER_ID").select("CUSTOMER_HK", "CUSTOMER_ID")
    feeds.append_increment(hub.where("CUSTOMER_ID % 3 = 0"), path, ["CUSTOMER_HK"])
    feeds.append_increment(hub, path, ["CUSTOMER_HK"])
    feeds.append_increment(hub, path, ["CUSTOMER_HK"])
    return spark.read.parquet(path)


@query("s6_stage_view", "SELECT o_orderstatus, count(*) AS n_rows FROM orders GROUP BY o_orderstatus")
def s6(spark, d):
    return feeds.stage_view(orders_stage(spark, d), "stg_orders").groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"))


# Staging


@query("t1_normalize_identifier", "SELECT p_partkey, upper(trim(regexp_replace(p_type, '[^0-9a-zA-Z]+', '_', 'g'), '_')) AS name FROM part")
def t1(spark, d):
    return table(spark, d, "part").select("p_partkey", normalize_identifier("p_type").alias("name"))


@query("t2_hash_key", f"SELECT c_custkey, {hashed('c_custkey')} AS CUSTOMER_HK, {hashed('c_name')} AS NAME_HK FROM customer")
def t2(spark, d):
    return table(spark, d, "customer").select("c_custkey", hash_key(["c_custkey"]).alias("CUSTOMER_HK"), hash_key(["c_name"]).alias("NAME_HK"))


@query("t3_hash_key_composite", f"SELECT l_orderkey, l_linenumber, {hashed('l_orderkey', 'l_partkey', 'l_suppkey')} AS LINK_HK FROM lineitem")
def t3(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", hash_key(["l_orderkey", "l_partkey", "l_suppkey"]).alias("LINK_HK"))


@query("t3_hash_key_marks", f"""WITH x AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'A|' WHEN 1 THEN 'A' WHEN 2 THEN '^^' END AS a, CASE l_linenumber % 4 WHEN 0 THEN 'B' WHEN 1 THEN '|B' WHEN 3 THEN '^\\^' END AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, {hashed('a', 'b')} AS PAIR_HK, (SELECT count(DISTINCT {hashed('a', 'b')}) FROM x) AS n_keys FROM x""")
def t3_marks(spark, d):
    """Values with the separator and the mark of missing values in them: other values, other keys."""
    k = F.col("l_linenumber") % 4
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(k == 0, "A|").when(k == 1, "A").when(k == 2, "^^").alias("a"), F.when(k == 0, "B").when(k == 1, "|B").when(k == 3, "^\\^").alias("b"))
    keyed = x.select("l_orderkey", "l_linenumber", hash_key(["a", "b"]).alias("PAIR_HK"))
    return keyed.crossJoin(F.broadcast(keyed.agg(F.count_distinct("PAIR_HK").alias("n_keys"))))  # a single row


@query("t4_hashdiff", f"SELECT c_custkey, {hashed('c_name', 'nullif(c_mktsegment, upper(c_mktsegment))', 'CAST(c_acctbal AS DECIMAL(18,2))')} AS HASHDIFF FROM customer")
def t4(spark, d):
    return table(spark, d, "customer").select("c_custkey", hashdiff(["c_name", F.nullif("c_mktsegment", F.upper("c_mktsegment")), money("c_acctbal")]).alias("HASHDIFF"))


@query("t5_derive", "SELECT o_orderkey, o_orderdate AS APPLIED_DTS FROM orders")
def t5(spark, d):
    return stage.derive(table(spark, d, "orders"), {"APPLIED_DTS": "o_orderdate"}).select("o_orderkey", "APPLIED_DTS")


@query("t6_role_hash", f"SELECT s_suppkey, {hashed('s_nationkey')} AS NATION_SUPPLIER_HK FROM supplier")
def t6(spark, d):
    return stage.role_hash(table(spark, d, "supplier"), "nation", "supplier", "s_nationkey").select("s_suppkey", "NATION_SUPPLIER_HK")


@query("t7_canonical_key", "SELECT o_orderkey, o_custkey AS CUSTOMER_ID FROM orders")
def t7(spark, d):
    return stage.canonical_key(table(spark, d, "orders"), "customer", "o_custkey", ["c_custkey", "o_custkey"]).select("o_orderkey", "CUSTOMER_ID")


@query("t8_alias_fk", f"SELECT l_orderkey, l_linenumber, l_partkey AS p_partkey, {hashed('l_partkey')} AS P_PARTKEY_HK FROM lineitem")
def t8(spark, d):
    return stage.alias_fk(table(spark, d, "lineitem"), "p_partkey", "l_partkey").select("l_orderkey", "l_linenumber", "p_partkey", "P_PARTKEY_HK")


@query("t9_stage_finer_grain", f"SELECT l_orderkey, l_linenumber, {hashed('l_orderkey')} AS ORDER_HK FROM lineitem")
def t9(spark, d):
    return stage.stage_finer_grain(table(spark, d, "lineitem"), "ORDER_HK", ["l_orderkey"]).select("l_orderkey", "l_linenumber", "ORDER_HK")


@query("t10_stage", f"WITH {ORDERS} SELECT ORDER_ID, CUSTOMER_ID, ORDER_HK, CUSTOMER_HK, ORDER_CUSTOMER_HK, HASHDIFF, LOAD_DATETIME, RECORD_SOURCE FROM o")
def t10(spark, d):
    return orders_stage(spark, d).select("ORDER_ID", "CUSTOMER_ID", "ORDER_HK", "CUSTOMER_HK", "ORDER_CUSTOMER_HK", "HASHDIFF", "LOAD_DATETIME", "RECORD_SOURCE")


@query("t11_with_load_metadata", "SELECT o_orderkey, o_orderdate AS LOAD_DATETIME, 'erp' AS RECORD_SOURCE FROM orders")
def t11(spark, d):
    return stage.with_load_metadata(table(spark, d, "orders"), "o_orderdate", "erp").select("o_orderkey", "LOAD_DATETIME", "RECORD_SOURCE")


# Loads: two cuts, so three batches; the SQL is the closed form


@query("l1_load_hub", f"WITH {ORDERS} SELECT CUSTOMER_HK, CUSTOMER_ID, min(LOAD_DATETIME) AS LOAD_DATETIME, 'orders' AS RECORD_SOURCE FROM o GROUP BY 1, 2")
def l1(spark, d):
    return run_batches(orders_stage(spark, d), CUTS, lambda b, t: load.load_hub(b, t, "CUSTOMER_HK", "CUSTOMER_ID"))


@query(
    "l2_load_hub_two_feeds",
    f"""WITH {ORDERS}, {CUSTOMERS}, u AS (SELECT CUSTOMER_HK, CUSTOMER_ID, LOAD_DATETIME, RECORD_SOURCE FROM o UNION ALL SELECT CUSTOMER_HK, CUSTOMER_ID, LOAD_DATETIME, RECORD_SOURCE FROM c)
    SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY CUSTOMER_HK ORDER BY LOAD_DATETIME, RECORD_SOURCE) = 1""",
)
def l2(spark, d):
    columns = ["CUSTOMER_HK", "CUSTOMER_ID", "LOAD_DATETIME", "RECORD_SOURCE"]
    both = [orders_stage(spark, d).select(*columns), customer_stage(spark, d).select(*columns)]
    return run_batches(feeds.union_feeds(both), CUTS, lambda b, t: load.load_hub([b.where("RECORD_SOURCE = 'orders'"), b.where("RECORD_SOURCE = 'customer'")], t, "CUSTOMER_HK", "CUSTOMER_ID"))


@query("l3_load_link", f"WITH {ORDERS} SELECT ORDER_CUSTOMER_HK, ORDER_HK, CUSTOMER_HK, min(LOAD_DATETIME) AS LOAD_DATETIME, 'orders' AS RECORD_SOURCE FROM o GROUP BY 1, 2, 3")
def l3(spark, d):
    return run_batches(orders_stage(spark, d), CUTS, lambda b, t: load.load_link(b, t, "ORDER_CUSTOMER_HK", ["ORDER_HK", "CUSTOMER_HK"], ["ORDER_ID", "CUSTOMER_ID"]))


@query(
    "l4_load_link_roles",
    f"""WITH t AS (SELECT DISTINCT l_orderkey, l_suppkey, l_shipdate FROM lineitem), x AS (
      SELECT {hashed('c_nationkey', 's_nationkey')} AS NATIONS_HK, {hashed('c_nationkey')} AS NATION_CUSTOMER_HK, {hashed('s_nationkey')} AS NATION_SUPPLIER_HK, l_shipdate
      FROM t JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
    SELECT NATIONS_HK, NATION_CUSTOMER_HK, NATION_SUPPLIER_HK, min(l_shipdate) AS LOAD_DATETIME, 'trade' AS RECORD_SOURCE FROM x GROUP BY 1, 2, 3""",
)
def l4(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    joined = li.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = stage.with_load_metadata(stage.role_hash(stage.role_hash(joined, "nation", "customer", "c_nationkey"), "nation", "supplier", "s_nationkey"), "l_shipdate", "trade")
    rows = rows.withColumn("NATIONS_HK", hash_key(["c_nationkey", "s_nationkey"]))
    return load.load_link(rows, None, "NATIONS_HK", ["NATION_CUSTOMER_HK", "NATION_SUPPLIER_HK"])


def line_staged(spark, d):
    spec = stage.StageSpec(
        derived={"QUANTITY": money("l_quantity"), "PRICE": money("l_extendedprice"), "SHIPPED": "l_shipdate"},
        keys={"LINE_HK": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "ORDER_HK": ["l_orderkey"], "PART_HK": ["l_partkey"], "SUPPLIER_HK": ["l_suppkey"]},
        diffs={"HASHDIFF": ["QUANTITY", "PRICE"]},
        ldts="l_shipdate",
        source="lineitem",
    )
    return stage.Staged(table(spark, d, "lineitem"), spec)


def line_stage(spark, d):
    return line_staged(spark, d).rows()


LINES = f"""l AS (SELECT {hashed('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber')} AS LINE_HK, {hashed('l_orderkey')} AS ORDER_HK, {hashed('l_partkey')} AS PART_HK, {hashed('l_suppkey')} AS SUPPLIER_HK,
  CAST(l_quantity AS DECIMAL(18,2)) AS QUANTITY, CAST(l_extendedprice AS DECIMAL(18,2)) AS PRICE, {hashed('CAST(l_quantity AS DECIMAL(18,2))', 'CAST(l_extendedprice AS DECIMAL(18,2))')} AS HASHDIFF,
  l_shipdate AS SHIPPED, l_shipdate AS LOAD_DATETIME, 'lineitem' AS RECORD_SOURCE, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem)"""


@query(
    "l5_load_t_link",
    f"""WITH {LINES} SELECT LINE_HK, ORDER_HK, PART_HK, SUPPLIER_HK, SHIPPED, CAST(QUANTITY AS DOUBLE) AS QUANTITY, CAST(PRICE AS DOUBLE) AS PRICE, LOAD_DATETIME, RECORD_SOURCE FROM l
    QUALIFY row_number() OVER (PARTITION BY LINE_HK ORDER BY LOAD_DATETIME, QUANTITY, PRICE) = 1""",
)
def l5(spark, d):
    out = run_batches(line_staged(spark, d), CUTS, lambda b, t: load.load_t_link(b.rows("LINE_HK"), t, "LINE_HK", ["ORDER_HK", "PART_HK", "SUPPLIER_HK"], ["QUANTITY", "PRICE"], "SHIPPED"))
    return out.withColumns({"QUANTITY": F.col("QUANTITY").cast("double"), "PRICE": F.col("PRICE").cast("double")})


@query(
    "l5_rejected_events",
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 = 0 THEN 'no_participation' ELSE 'no_event_time' END AS reason FROM lineitem WHERE l_partkey % 7 = 0 OR l_linenumber = 3""",
)
def l5_rejected(spark, d):
    """Events that name no part, or have no date, load nothing and are told."""
    rows = line_stage(spark, d).withColumns({"PART_HK": F.when(F.col("l_partkey") % 7 != 0, F.col("PART_HK")), "SHIPPED": F.when(F.col("l_linenumber") != 3, F.col("SHIPPED"))})
    return load.rejected_events(rows, ["ORDER_HK", "PART_HK", "SUPPLIER_HK"], "SHIPPED").select("l_orderkey", "l_linenumber", "reason")


EVENT_CUTS = ["2024-01-10", "2024-01-20"]
SAT = "HASHDIFF IS DISTINCT FROM lag(HASHDIFF) OVER (PARTITION BY {pk} ORDER BY LOAD_DATETIME)"


@query("l6_load_sat", f"WITH {EVENTS} SELECT USER_HK, HASHDIFF, event_type, LOAD_DATETIME, RECORD_SOURCE FROM e QUALIFY {SAT.format(pk='USER_HK')}")
def l6(spark, d):
    return run_batches(events_stage(spark, d), EVENT_CUTS, lambda b, t: load.load_sat(b, t, "USER_HK", "HASHDIFF", ["event_type"]))


@query(
    "l6_late_rows",
    f"""WITH {EVENTS}, b AS (SELECT * FROM e WHERE LOAD_DATETIME < TIMESTAMP '2024-01-16 00:00:00'), t AS (SELECT USER_HK, HASHDIFF, LOAD_DATETIME FROM b QUALIFY {SAT.format(pk='USER_HK')}),
    m AS (SELECT USER_HK, max(LOAD_DATETIME) AS latest, arg_max(HASHDIFF, LOAD_DATETIME) AS diff FROM t GROUP BY USER_HK), x AS (SELECT USER_HK, event_id, HASHDIFF, LOAD_DATETIME FROM e UNION ALL SELECT USER_HK, -m_id, md5(HASHDIFF), LOAD_DATETIME FROM (SELECT t.*, user_id AS m_id FROM t JOIN (SELECT DISTINCT USER_HK, user_id FROM e) USING (USER_HK)))
    SELECT USER_HK, event_id, HASHDIFF, LOAD_DATETIME FROM x JOIN m USING (USER_HK) WHERE LOAD_DATETIME < latest OR (LOAD_DATETIME = latest AND HASHDIFF <> diff)""",
)
def l6_late(spark, d):
    """Rows of a batch that are older than what is loaded, or as old and different."""
    e = events_stage(spark, d)
    sat = load.load_sat(e.where("LOAD_DATETIME < '2024-01-16'"), None, "USER_HK", "HASHDIFF", ["event_type"])
    ids = e.select("USER_HK", "user_id").distinct()
    other = sat.join(ids, "USER_HK").select("USER_HK", (-F.col("user_id")).alias("event_id"), F.md5("HASHDIFF").alias("HASHDIFF"), "LOAD_DATETIME")
    return load.late_rows(e.select("USER_HK", "event_id", "HASHDIFF", "LOAD_DATETIME").unionByName(other), sat, "USER_HK", "HASHDIFF")


def priority_stage(spark, d):
    spec = stage.StageSpec(derived={"VALUE": "o_orderpriority"}, keys={"CUSTOMER_HK": ["o_custkey"]}, diffs={"HASHDIFF": ["o_orderpriority"]}, ldts="o_orderdate", source="orders")
    return stage.stage(table(spark, d, "orders"), spec)


def segment_stage(spark, d):
    spec = stage.StageSpec(derived={"VALUE": "c_mktsegment"}, keys={"CUSTOMER_HK": ["c_custkey"]}, diffs={"HASHDIFF": ["c_mktsegment"]}, ldts=F.lit("1996-06-01").cast("timestamp"), source="customer")
    return stage.stage(table(spark, d, "customer"), spec)


PRIORITY_SAT = f"""SELECT CUSTOMER_HK, HASHDIFF, VALUE, LOAD_DATETIME, RECORD_SOURCE FROM (
  SELECT {hashed('o_custkey')} AS CUSTOMER_HK, {hashed('o_orderpriority')} AS HASHDIFF, o_orderpriority AS VALUE, o_orderdate AS LOAD_DATETIME, 'orders' AS RECORD_SOURCE FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY {hashed('o_orderpriority')}) = 1) QUALIFY {SAT.format(pk='CUSTOMER_HK')}"""
SEGMENT_SAT = f"SELECT {hashed('c_custkey')} AS CUSTOMER_HK, {hashed('c_mktsegment')} AS HASHDIFF, c_mktsegment AS VALUE, TIMESTAMP '1996-06-01 00:00:00' AS LOAD_DATETIME, 'customer' AS RECORD_SOURCE FROM customer"


@query("l7_load_sat_per_feed", f"SELECT *, 'orders' AS feed FROM ({PRIORITY_SAT}) UNION ALL SELECT *, 'customer' FROM ({SEGMENT_SAT})")
def l7(spark, d):
    out = load.load_sat_per_feed({"orders": priority_stage(spark, d), "customer": segment_stage(spark, d)}, {}, "CUSTOMER_HK", "HASHDIFF", ["VALUE"])
    return feeds.union_feeds([df.withColumn("feed", F.lit(n)) for n, df in out.items()])


@query("l8_load_sat_bound", SEGMENT_SAT)
def l8(spark, d):
    return load.load_sat_bound({"orders": priority_stage(spark, d), "customer": segment_stage(spark, d)}, "customer", None, "CUSTOMER_HK", "HASHDIFF", ["VALUE"])


@query("l9_load_sat_on_link", f"WITH {ORDERS} SELECT ORDER_CUSTOMER_HK, HASHDIFF, o_orderstatus, LOAD_DATETIME, RECORD_SOURCE FROM o QUALIFY {SAT.format(pk='ORDER_CUSTOMER_HK')}")
def l9(spark, d):
    return run_batches(orders_stage(spark, d), CUTS, lambda b, t: load.load_sat(b, t, "ORDER_CUSTOMER_HK", "HASHDIFF", ["o_orderstatus"]))


def multi_active_staged(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money("l_quantity").alias("QUANTITY"))
    first = lines.withColumn("LOAD_DATETIME", F.lit("2002-01-01").cast("timestamp"))
    more = F.col("QUANTITY") + F.when((F.col("l_orderkey") % 10 == 0) & (F.col("l_linenumber") == 1), 1).otherwise(0)
    second = lines.withColumns({"QUANTITY": more.cast("decimal(18,2)"), "LOAD_DATETIME": F.lit("2002-02-01").cast("timestamp")})
    return stage.Staged(first.unionByName(second), stage.StageSpec(keys={"ORDER_HK": ["l_orderkey"]}, diffs={"HASHDIFF": ["QUANTITY"]}, source="lineitem"))


def multi_active(spark, d):
    return multi_active_staged(spark, d).rows()


MA = f"""WITH x AS (
  SELECT {hashed('l_orderkey')} AS ORDER_HK, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DECIMAL(18,2)) AS Q, TIMESTAMP '2002-01-01 00:00:00' AS LOAD_DATETIME FROM lineitem
  UNION ALL SELECT {hashed('l_orderkey')}, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_quantity AS DECIMAL(18,2)) + CASE WHEN l_orderkey % 10 = 0 AND l_linenumber = 1 THEN 1 ELSE 0 END AS DECIMAL(18,2)), TIMESTAMP '2002-02-01 00:00:00' FROM lineitem
), y AS (SELECT *, {hashed('Q')} AS HASHDIFF FROM x), changed AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 10 = 0 AND l_linenumber = 1)
SELECT DISTINCT ORDER_HK, l_linenumber, l_partkey, l_suppkey, HASHDIFF, CAST(Q AS DOUBLE) AS QUANTITY, LOAD_DATETIME, 'lineitem' AS RECORD_SOURCE FROM y
WHERE LOAD_DATETIME < TIMESTAMP '2002-02-01 00:00:00' OR l_orderkey IN (SELECT l_orderkey FROM changed)"""


@query("l10_load_ma_sat", MA)
def l10(spark, d):
    out = run_batches(multi_active_staged(spark, d), ["2002-01-15"], lambda b, t: load.load_ma_sat(b, t, "ORDER_HK", ["l_linenumber", "l_partkey", "l_suppkey"], "HASHDIFF", ["QUANTITY"]))
    return out.withColumn("QUANTITY", F.col("QUANTITY").cast("double"))


@query(
    "l10_late_sets",
    f"""SELECT {hashed('l_orderkey')} AS ORDER_HK, l_orderkey, l_linenumber, l_partkey, l_suppkey, TIMESTAMP '2002-01-01 00:00:00' AS LOAD_DATETIME FROM lineitem WHERE l_orderkey % 10 = 0 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)
    UNION ALL SELECT {hashed('l_orderkey')}, l_orderkey, l_linenumber, l_partkey, l_suppkey, TIMESTAMP '2002-02-01 00:00:00' FROM lineitem WHERE l_orderkey % 30 = 0 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)""",
)
def l10_late(spark, d):
    """Sets that are older than what is loaded, and sets as old with other members."""
    rows = multi_active_staged(spark, d)
    key = ["l_linenumber", "l_partkey", "l_suppkey"]
    held = load.load_ma_sat(rows, None, "ORDER_HK", key, "HASHDIFF", ["QUANTITY"])
    other = rows.then(lambda df: df.withColumn("HASHDIFF", F.when((F.col("l_orderkey") % 30 == 0) & (F.col("LOAD_DATETIME") > "2002-01-15"), F.md5("HASHDIFF")).otherwise(F.col("HASHDIFF"))))
    return load.late_sets(other, held, "ORDER_HK", key, "HASHDIFF", target_rows=rows.df.count()).select("ORDER_HK", "l_orderkey", *key, "LOAD_DATETIME")


SNAPSHOTS = ["2024-01-08", "2024-01-16", "2024-01-24"]


def snapshots(spark, d, keys):
    """The last event of each key up to each snapshot date, as one batch a date."""
    e = events_stage(spark, d).withColumn("HALF", F.col("event_id") % 2)
    frames = []
    for at in SNAPSHOTS:
        upto = e.where(F.col("ts") < F.lit(at).cast("timestamp")).groupBy(*keys).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x"))
        frames.append(upto.select(*keys, F.col("x.event_type").alias("event_type"), F.col("x.ts").alias("START_DATE"), F.lit(at).cast("timestamp").alias("LOAD_DATETIME"), F.lit("events").alias("RECORD_SOURCE")))
    return feeds.union_feeds(frames).withColumn("EFF_HK", hash_key([*keys, "event_type"]))


def dated(df):
    """End dates as text: some clients can't hold the high date."""
    return df.withColumn("END_DATE", F.col("END_DATE").cast("string"))


def islands(keys: str, rows: str, first: str) -> str:
    """Closed form of effectivity over snapshots: one record opens each run of equal partners, one closes it."""
    return f"""WITH {rows}, h AS (SELECT * FROM s QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY {keys} ORDER BY LOAD_DATETIME)),
    p AS (SELECT *, lag(event_type) OVER w AS old_type, lag(START_DATE) OVER w AS old_start FROM h WINDOW w AS (PARTITION BY {keys} ORDER BY LOAD_DATETIME))
    SELECT {first.format(t='event_type')}, START_DATE, CAST({HIGH} AS VARCHAR) AS END_DATE, LOAD_DATETIME, 'events' AS RECORD_SOURCE FROM p
    UNION ALL SELECT {first.format(t='old_type')}, old_start, CAST(START_DATE AS VARCHAR), LOAD_DATETIME, 'events' FROM p WHERE old_type IS NOT NULL"""


def snapshot_sql(keys: str) -> str:
    parts = [f"SELECT {keys}, arg_max(event_type, ROW(ts, event_id)) AS event_type, max(ts) AS START_DATE, TIMESTAMP '{at} 00:00:00' AS LOAD_DATETIME FROM ev WHERE ts < TIMESTAMP '{at} 00:00:00' GROUP BY {keys}" for at in SNAPSHOTS]
    return "ev AS (SELECT *, event_id % 2 AS HALF FROM events), s AS (" + " UNION ALL ".join(parts) + ")"


@query("l11_load_eff_sat", islands("user_id", snapshot_sql("user_id"), hashed("user_id", "{t}") + " AS EFF_HK, user_id, {t} AS event_type"))
def l11(spark, d):
    return dated(run_batches(snapshots(spark, d, ["user_id"]), SNAPSHOTS[1:], lambda b, t: load.load_eff_sat(b, t, "EFF_HK", ["user_id"], ["event_type"])))


@query("l12_load_eff_sat_two_driving_keys", islands("user_id, HALF", snapshot_sql("user_id, HALF"), hashed("user_id", "HALF", "{t}") + " AS EFF_HK, user_id, HALF, {t} AS event_type"))
def l12(spark, d):
    return dated(run_batches(snapshots(spark, d, ["user_id", "HALF"]), SNAPSHOTS[1:], lambda b, t: load.load_eff_sat(b, t, "EFF_HK", ["user_id", "HALF"], ["event_type"])))


DAILY = "s AS (SELECT user_id, arg_max(event_type, ROW(ts, event_id)) AS event_type, max(ts) AS START_DATE, date_trunc('day', ts)::TIMESTAMP AS LOAD_DATETIME FROM events GROUP BY user_id, 4)"


def daily_states(spark, d):
    day = F.date_trunc("day", "ts").alias("LOAD_DATETIME")
    last = table(spark, d, "events").groupBy("user_id", day).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x"))
    rows = last.select("user_id", "LOAD_DATETIME", F.col("x.event_type").alias("event_type"), F.col("x.ts").alias("START_DATE"), F.lit("events").alias("RECORD_SOURCE"))
    return rows.withColumn("EFF_HK", hash_key(["user_id", "event_type"]))


@query("l13_eff_sat_from_history", islands("user_id", DAILY, hashed("user_id", "{t}") + " AS EFF_HK, user_id, {t} AS event_type"))
def l13(spark, d):
    return dated(load.eff_sat_from_history(daily_states(spark, d), "EFF_HK", ["user_id"], ["event_type"]))


def daily_sets(spark, d):
    """All event types of a user on a day: several relationships of one driving key in a snapshot."""
    day = F.date_trunc("day", "ts").alias("LOAD_DATETIME")
    rows = table(spark, d, "events").groupBy("user_id", "event_type", day).agg(F.min("ts").alias("START_DATE")).withColumn("RECORD_SOURCE", F.lit("events"))
    return rows.withColumn("EFF_HK", hash_key(["user_id", "event_type"]))


@query(
    "l13_eff_sat_sets",
    f"""WITH RECURSIVE h AS (SELECT user_id, event_type, date_trunc('day', ts)::TIMESTAMP AS day, min(ts) AS start FROM events GROUP BY ALL),
    c AS (SELECT user_id, min(day) AS day, 1 AS k FROM h GROUP BY user_id
      UNION ALL SELECT c.user_id, min(x.day), any_value(c.k) + 1 FROM c JOIN h x ON x.user_id = c.user_id AND x.day > c.day LEFT JOIN h y ON y.user_id = c.user_id AND y.day = c.day AND y.event_type = x.event_type WHERE y.user_id IS NULL GROUP BY c.user_id),
    s AS (SELECT c.user_id, k, c.day, event_type, start FROM c JOIN h ON h.user_id = c.user_id AND h.day = c.day),
    o AS (SELECT a.* FROM s a LEFT JOIN s b ON b.user_id = a.user_id AND b.event_type = a.event_type AND b.k = a.k - 1 WHERE b.user_id IS NULL),
    g AS (SELECT user_id, k, any_value(day) AS day, min(start) AS ends FROM o GROUP BY user_id, k),
    z AS (SELECT a.user_id, a.event_type, g.day, g.ends, (SELECT max(o.start) FROM o WHERE o.user_id = a.user_id AND o.event_type = a.event_type AND o.k <= a.k) AS start
      FROM s a JOIN g ON g.user_id = a.user_id AND g.k = a.k + 1 LEFT JOIN s b ON b.user_id = a.user_id AND b.event_type = a.event_type AND b.k = a.k + 1 WHERE b.user_id IS NULL)
    SELECT {hashed('user_id', 'event_type')} AS EFF_HK, user_id, event_type, start AS START_DATE, CAST({HIGH} AS VARCHAR) AS END_DATE, day AS LOAD_DATETIME, 'events' AS RECORD_SOURCE FROM o
    UNION ALL SELECT {hashed('user_id', 'event_type')}, user_id, event_type, start, CAST(ends AS VARCHAR), day, 'events' FROM z""",
)
def l13_sets(spark, d):
    return dated(load.eff_sat_from_history(daily_sets(spark, d), "EFF_HK", ["user_id"], ["event_type"]))


@query("l14_load_fk_link", f"SELECT {hashed('o_orderkey', 'o_custkey')} AS FK_HK, {hashed('o_orderkey')} AS ORDER_HK, {hashed('o_custkey')} AS C_CUSTKEY_HK, min(o_orderdate) AS LOAD_DATETIME, 'orders' AS RECORD_SOURCE FROM orders GROUP BY 1, 2, 3")
def l14(spark, d):
    rows = stage.with_load_metadata(table(spark, d, "orders"), "o_orderdate", "orders")
    return load.load_fk_link(rows, None, "FK_HK", "ORDER_HK", "o_orderkey", "c_custkey", "o_custkey")


@query("l6_load_sat_with_heads", f"WITH {EVENTS} SELECT USER_HK, HASHDIFF, event_type, LOAD_DATETIME, RECORD_SOURCE FROM e QUALIFY {SAT.format(pk='USER_HK')}")
def l6_heads(spark, d):
    """Batches, one of them twice, that meet the latest row of each key and not the history."""
    path, e = feeds.shared_folder(spark), events_stage(spark, d)
    for name, where in (("a", "ts < '2024-01-10'"), ("b", "ts >= '2024-01-10' AND ts < '2024-01-20'"), ("b", "ts >= '2024-01-10' AND ts < '2024-01-20'"), ("c", "ts >= '2024-01-20'")):
        heads.load_sat_with_heads(e.where(where), path, name, "USER_HK", "HASHDIFF", ["event_type"])
    return heads.read_history(spark, path)


@query("l10_load_ma_sat_with_heads", MA)
def l10_heads(spark, d):
    path, rows = feeds.shared_folder(spark), multi_active(spark, d)
    for name, where in (("a", "LOAD_DATETIME < '2002-01-15'"), ("b", "LOAD_DATETIME > '2002-01-15'"), ("c", "LOAD_DATETIME > '2002-01-15'")):
        heads.load_ma_sat_with_heads(rows.where(where), path, name, "ORDER_HK", ["l_linenumber", "l_partkey", "l_suppkey"], "HASHDIFF", ["QUANTITY"])
    out = heads.read_history(spark, path)
    return out.withColumn("QUANTITY", F.col("QUANTITY").cast("double"))


@query("l11_load_eff_sat_with_heads", islands("user_id", snapshot_sql("user_id"), hashed("user_id", "{t}") + " AS EFF_HK, user_id, {t} AS event_type"))
def l11_heads(spark, d):
    path, rows = feeds.shared_folder(spark), snapshots(spark, d, ["user_id"])
    for at in [*SNAPSHOTS, SNAPSHOTS[-1]]:
        heads.load_eff_sat_with_heads(rows.where(F.col("LOAD_DATETIME") == F.lit(at).cast("timestamp")), path, at, "EFF_HK", ["user_id"], ["event_type"])
    return dated(heads.read_history(spark, path))


SPEC = VaultSpec(
    hubs=[Hub("hub_customer", ["orders", "customer"], "CUSTOMER_HK", "CUSTOMER_ID"), Hub("hub_order", ["orders"], "ORDER_HK", "ORDER_ID")],
    links=[Link("link_order_customer", "orders", "ORDER_CUSTOMER_HK", ["ORDER_HK", "CUSTOMER_HK"])],
    satellites=[Satellite("sat_order", "orders", "ORDER_HK", payload=["o_orderstatus"]), Satellite("sat_customer", "customer", "CUSTOMER_HK", payload=["c_mktsegment"])],
)


@query(
    "l15_load_vault",
    f"""WITH {ORDERS} SELECT 'hub_customer' AS table_name, count(*) AS n_rows FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)
    UNION ALL SELECT 'hub_order', count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'link_order_customer', count(DISTINCT ORDER_CUSTOMER_HK) FROM o
    UNION ALL SELECT 'sat_customer', count(*) FROM customer UNION ALL SELECT 'sat_order', count(*) FROM (SELECT 1 FROM o QUALIFY {SAT.format(pk='ORDER_HK')})""",
)
def l15(spark, d):
    path = feeds.shared_folder(spark)
    orders = orders_stage(spark, d)
    for batch in (orders.where("LOAD_DATETIME < '1998-01-01'"), orders, orders):
        paths = load_vault(spark, SPEC, {"orders": batch, "customer": customer_stage(spark, d)}, path)
    return read.vault_counts({n: spark.read.parquet(p) for n, p in paths.items()})


ALL_PARTS = VaultSpec(
    hubs=SPEC.hubs[:1],
    links=[SPEC.links[0], Link("t_line", "lines", "LINE_HK", ["ORDER_HK", "PART_HK", "SUPPLIER_HK"], event_time="SHIPPED", payload=["QUANTITY", "PRICE"])],
    satellites=[
        SPEC.satellites[1],
        Satellite("sat_lines", "sets", "ORDER_HK", payload=["QUANTITY"], kind="multi_active", child_keys=["l_linenumber", "l_partkey", "l_suppkey"]),
        Satellite("eff_user", "states", "EFF_HK", kind="effectivity", driving=["user_id"], secondary=["event_type"]),
    ],
)
EFF_USER = islands("user_id", snapshot_sql("user_id"), hashed("user_id", "{t}") + " AS EFF_HK, user_id, {t} AS event_type")


@query(
    "l15_load_vault_parts",
    f"""WITH {ORDERS}, {LINES}, u AS (
      SELECT 'hub_customer' AS table_name, hk, min(at_time) AS LOAD_DATETIME, 1 AS n FROM (SELECT {hashed('o_custkey')} AS hk, o_orderdate AS at_time FROM orders UNION ALL SELECT {hashed('c_custkey')}, TIMESTAMP '1996-06-01 00:00:00' FROM customer) GROUP BY hk
      UNION ALL SELECT 'link_order_customer', ORDER_CUSTOMER_HK, min(LOAD_DATETIME), 1 FROM o GROUP BY ORDER_CUSTOMER_HK
      UNION ALL SELECT 't_line', LINE_HK, min(LOAD_DATETIME), 1 FROM l GROUP BY LINE_HK
      UNION ALL SELECT 'sat_customer', {hashed('c_custkey')}, TIMESTAMP '1996-06-01 00:00:00', 1 FROM customer
      UNION ALL SELECT 'sat_lines', ORDER_HK, LOAD_DATETIME, count(*) FROM ({MA}) GROUP BY ORDER_HK, LOAD_DATETIME
      UNION ALL SELECT 'eff_user', EFF_HK, LOAD_DATETIME, count(*) FROM ({EFF_USER}) GROUP BY EFF_HK, LOAD_DATETIME)
    SELECT table_name, hk, LOAD_DATETIME, CAST(n AS BIGINT) AS n FROM u""",
)
def l15_parts(spark, d):
    """A bucketed vault with all kinds of part, loaded in three batches and the last of them again."""
    database = f"keelvault_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database}")
    orders, lines, sets, states = orders_staged(spark, d), line_staged(spark, d), multi_active_staged(spark, d), snapshots(spark, d, ["user_id"])
    sources = {"hub_customer": "customer", "link_order_customer": "orders", "t_line": "lineitem", "sat_customer": "customer", "sat_lines": "lineitem", "eff_user": "events"}
    counted = {t: buckets_for(table(spark, d, t).count()) for t in set(sources.values())}
    buckets = {part: counted[t] for part, t in sources.items()}
    for i, at in enumerate([*SNAPSHOTS, SNAPSHOTS[-1]]):
        stages = {
            "orders": orders.where("LOAD_DATETIME < '1998-01-01'") if i == 0 else orders,
            "customer": customer_stage(spark, d),
            "lines": lines.where("LOAD_DATETIME < '1998-01-01'") if i == 0 else lines,
            "sets": sets.where("LOAD_DATETIME < '2002-01-15'") if i == 0 else sets.where("LOAD_DATETIME > '2002-01-15'"),
            "states": states.where(F.col("LOAD_DATETIME") == F.lit(at).cast("timestamp")),
        }
        names = load_bucketed_vault(spark, ALL_PARTS, stages, database, buckets)
    keys = {p.name: p.pk for p in (*ALL_PARTS.hubs, *ALL_PARTS.links, *ALL_PARTS.satellites)}
    counts = {n: spark.table(t).groupBy(F.col(keys[n]).alias("hk"), "LOAD_DATETIME").agg(F.count("*").alias("n")) for n, t in names.items()}  # where rows lie
    return feeds.union_feeds([df.select(F.lit(n).alias("table_name"), "hk", "LOAD_DATETIME", "n") for n, df in counts.items()])


TRADES = VaultSpec(links=[Link("link_trade", "trades", "TRADE_HK", ["NATION_CUSTOMER_HK", "NATION_SUPPLIER_HK"], event_time="l_shipdate", payload=["QUANTITY"], degenerate_key=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], roles=[("nation", "customer", "c_nationkey"), ("nation", "supplier", "s_nationkey")])])


@query(
    "l15_load_vault_events",
    f"""WITH x AS (SELECT c_nationkey, s_nationkey, l_shipdate, CAST(l_quantity AS DECIMAL(18,2)) AS Q, l_orderkey, l_partkey, l_suppkey, l_linenumber, {hashed('c_nationkey', 's_nationkey')} AS PAIR
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
    SELECT {hashed('PAIR', 'l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber')} AS TRADE_HK, {hashed('c_nationkey')} AS NATION_CUSTOMER_HK, {hashed('s_nationkey')} AS NATION_SUPPLIER_HK, l_shipdate, CAST(Q AS DOUBLE) AS QUANTITY, l_shipdate AS LOAD_DATETIME, 'trade' AS RECORD_SOURCE FROM x
    QUALIFY row_number() OVER (PARTITION BY TRADE_HK ORDER BY l_shipdate, Q) = 1""",
)
def l15_events(spark, d):
    """Events between the same two hubs, in roles, told apart by a degenerate key, loaded by a plan."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", money("l_quantity").alias("QUANTITY"))
    joined = li.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    joined = feeds.written(joined.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "QUANTITY", "c_nationkey", "s_nationkey"), "trades")  # joined once for all batches
    rows = stage.stage(joined, stage.StageSpec(keys={"TRADE_HK": ["c_nationkey", "s_nationkey"]}, ldts="l_shipdate", source="trade"))
    path = feeds.shared_folder(spark)
    for batch in (rows.where("l_shipdate < '1998-01-01'"), rows, rows):
        paths = load_vault(spark, TRADES, {"trades": batch}, path)
    out = spark.read.parquet(paths["link_trade"])
    return out.withColumn("QUANTITY", F.col("QUANTITY").cast("double"))


# Reads


@query("q1_current_rows", "SELECT user_id, ts AS LOAD_DATETIME, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, event_id DESC) = 1")
def q1(spark, d):
    return read.current_rows(table(spark, d, "events").select("user_id", F.col("ts").alias("LOAD_DATETIME"), "event_type", "event_id"), ["user_id"])


@query("q2_relationship_history", f"SELECT user_id AS USER_ID, event_type AS TYPE_ID, START_DATE, END_DATE, LOAD_DATETIME FROM ({islands('user_id', DAILY, 'user_id, {t} AS event_type')})")
def q2(spark, d):
    eff = l13(spark, d).withColumns({"USER_HK": hash_key(["user_id"]), "TYPE_HK": hash_key(["event_type"])})
    e = events_stage(spark, d)
    users = load.load_hub(e.withColumn("USER_ID", F.col("user_id")), None, "USER_HK", "USER_ID")
    types = load.load_hub(e.withColumn("TYPE_ID", F.col("event_type")), None, "TYPE_HK", "TYPE_ID")
    return read.relationship_history(eff.drop("user_id"), {"USER_HK": (users, "USER_HK", "USER_ID"), "TYPE_HK": (types, "TYPE_HK", "TYPE_ID")})


@query("q3_vault_counts", "SELECT 'customer' AS table_name, count(*) AS n_rows FROM customer UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders")
def q3(spark, d):
    return read.vault_counts({n: table(spark, d, n) for n in ("orders", "customer", "lineitem", "events")})


@query(
    "q4_hub_feed_membership",
    f"""SELECT {hashed('c_custkey')} AS CUSTOMER_HK, c_custkey AS CUSTOMER_ID, CASE WHEN r AND o THEN 'rich+late' WHEN r THEN 'rich' WHEN o THEN 'late' ELSE 'none' END AS feeds
    FROM (SELECT c_custkey, c_acctbal > 5000 AS r, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01 00:00:00') AS o FROM customer)""",
)
def q4(spark, d):
    hub = customer_stage(spark, d).select("CUSTOMER_HK", "CUSTOMER_ID")
    rich = customer_stage(spark, d).where("c_acctbal > 5000").select("CUSTOMER_HK")
    late = orders_stage(spark, d).where("LOAD_DATETIME >= '2001-06-01'").select("CUSTOMER_HK")
    return read.hub_feed_membership(hub, {"rich": rich, "late": late}, "CUSTOMER_HK")


@query(
    "flagship_orphans",
    f"""WITH {ORDERS}, {CUSTOMERS}, link AS (SELECT DISTINCT ORDER_HK, CUSTOMER_HK FROM o), hub AS (SELECT CUSTOMER_HK FROM o UNION SELECT CUSTOMER_HK FROM c)
    SELECT 'error' AS severity, 'E_LINK_UNKNOWN_HUB' AS code, 'link_order_customer.ORDER_HK' AS construct, count(*) AS n_rows FROM link WHERE ORDER_HK NOT IN (SELECT ORDER_HK FROM o)
    UNION ALL SELECT 'error', 'E_LINK_UNKNOWN_HUB', 'link_order_customer.CUSTOMER_HK', count(*) FROM link WHERE CUSTOMER_HK NOT IN (SELECT CUSTOMER_HK FROM hub)""",
)
def flagship(spark, d):
    """Stage, load a hub from two feeds and a link, and count the link's orphans."""
    from keelvault.operators.integrity import link_orphans

    orders = orders_stage(spark, d)
    hub = load.load_hub([orders, customer_stage(spark, d)], None, "CUSTOMER_HK", "CUSTOMER_ID")
    order_hub = load.load_hub(orders, None, "ORDER_HK", "ORDER_ID")
    link = load.load_link(orders, None, "ORDER_CUSTOMER_HK", ["ORDER_HK", "CUSTOMER_HK"])
    return link_orphans(link, "link_order_customer", {"ORDER_HK": (order_hub, "ORDER_HK"), "CUSTOMER_HK": (hub, "CUSTOMER_HK")})
