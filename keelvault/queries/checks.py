"""Queries of profiles, contracts, integrity checks, matching, extension and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelvault.operators import contract, extend, integrity, load, match, profile, score
from keelvault.queries.base import ORACLES, QUERIES, hashed, query, table
from keelvault.queries.build import CUSTOMERS, DAILY, ORDERS, customer_stage, daily_states, events_stage, islands, line_stage, multi_active, multi_active_staged, orders_stage, orders_staged
from keelvault.sources.feeds import shared_folder, union_feeds

CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


def profile_sql(name: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, 1 - count({c}) / count(*) AS null_ratio, count(DISTINCT {c}) AS distinct_count, coalesce(count(DISTINCT {c}) / nullif(count({c}), 0), 0.0) AS uniqueness_ratio FROM {name}"
        for c in columns
    )


CUSTOMER_PROFILE = profile_sql("customer", CUSTOMER_COLUMNS)


def customers(spark, d):
    return table(spark, d, "customer").select(*CUSTOMER_COLUMNS)


# Profiles


@query("p1_profile_columns", CUSTOMER_PROFILE)
def p1(spark, d):
    return profile.profile_columns(customers(spark, d))


@query("p2_profile_columns_approx")
def p2(spark, d):
    return profile.profile_columns(table(spark, d, "lineitem"), approx=True)


@query("p2_profile_by_batch", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, 1 - count({c}) / count(*) AS null_ratio, true AS near, true AS as_one_pass FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_quantity", "l_shipdate", "rare") ).replace("count(rare)", "count(nullif(l_linenumber, 7))"))
def p2_by_batch(spark, d):
    """A profile kept by batch: equal to the sketch of the whole table, and near the exact numbers."""
    path = shared_folder(spark)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate", F.nullif("l_linenumber", F.lit(7)).alias("rare"))
    for year, batch in (("a", rows.where("l_shipdate < '1998-01-01'")), ("b", rows.where("l_shipdate >= '1998-01-01'")), ("b", rows.where("l_shipdate >= '1998-01-01'"))):
        profile.add_to_profile(batch, path, year)
    whole = profile.profile_of(profile.profile_sketches(rows)).select("column_name", F.col("distinct_count").alias("whole"))
    exact = profile.profile_columns(rows).select("column_name", F.col("distinct_count").alias("exact"))
    met = profile.read_profile(spark, path).join(whole, "column_name").join(exact, "column_name")
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= 0.08 * F.col("exact")
    return met.select("column_name", "row_count", "null_ratio", near.alias("near"), (F.col("distinct_count") == F.col("whole")).alias("as_one_pass"))


@query("p3_example_values", " UNION ALL ".join(f"SELECT '{c}' AS column_name, array_to_string(list_sort(list(DISTINCT CAST({c} AS VARCHAR)))[1:3], '|') AS example_values FROM orders" for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")))
def p3(spark, d):
    return profile.example_values(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), 3).withColumn("example_values", F.array_join("example_values", "|"))


@query("p4_key_plausible", f"SELECT * FROM ({CUSTOMER_PROFILE}) WHERE uniqueness_ratio >= 0.95 AND null_ratio <= 0.05")
def p4(spark, d):
    return profile.key_plausible(p1(spark, d))


def guid_orders(spark, d):
    h = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    guid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", guid.alias("order_guid"))


@query(
    "p5_flag_technical_guid",
    """WITH g AS (SELECT o_orderkey, o_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS order_guid FROM (SELECT *, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)),
    x AS (SELECT 'order_guid' AS column_name, order_guid AS v FROM g UNION ALL SELECT 'o_orderkey', CAST(o_orderkey AS VARCHAR) FROM g UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM g)
    SELECT column_name, avg(CAST(regexp_matches(v, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') AS INT)) AS guid_ratio,
      guid_ratio = 1 AND count(DISTINCT v) = count(v) AS technical_guid FROM x GROUP BY column_name""",
)
def p5(spark, d):
    return profile.flag_technical_guid(guid_orders(spark, d))


@query("p6_flag_low_cardinality", f"SELECT * FROM ({CUSTOMER_PROFILE}) WHERE regexp_matches(lower(column_name), '(key|id|code|nr|no|number)$') AND uniqueness_ratio < 0.05")
def p6(spark, d):
    return profile.flag_low_cardinality(p1(spark, d), below=0.05)


@query("p7_rank_key_candidates", f"SELECT column_name, row_number() OVER (ORDER BY uniqueness_ratio DESC, null_ratio, column_name) AS key_rank FROM ({CUSTOMER_PROFILE}) WHERE uniqueness_ratio >= 0.95 AND null_ratio <= 0.05")
def p7(spark, d):
    df = customers(spark, d)
    return profile.rank_key_candidates(profile.profile_columns(df), profile.flag_technical_guid(df)).select("column_name", "key_rank")


@query(
    "p8_key_stability",
    """WITH n AS (SELECT c_name, CASE WHEN c_custkey % 7 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS k FROM customer)
    SELECT 'k' AS column_name, count(*) AS n_objects, avg(CAST(o.c_custkey <> n.k AS INT)) AS changed_ratio FROM customer o JOIN n USING (c_name)
    UNION ALL SELECT 'seg', count(*), 0.0 FROM customer o JOIN n USING (c_name)""",
)
def p8(spark, d):
    old = table(spark, d, "customer").select("c_name", F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))
    new = old.withColumn("k", F.when(F.col("k") % 7 == 0, F.col("k") + 1000000).otherwise(F.col("k")))
    return profile.key_stability(old, new, "c_name", ["k", "seg"])


@query(
    "p9_change_rate",
    """WITH x AS (SELECT row_number() OVER w AS n, CAST(event_type IS DISTINCT FROM lag(event_type) OVER w AS INT) AS t, CAST(props IS DISTINCT FROM lag(props) OVER w AS INT) AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT 'event_type' AS attribute, avg(t) AS change_rate, 2 AS payload_width, false AS too_wide FROM x WHERE n > 1 UNION ALL SELECT 'props', avg(p), 2, false FROM x WHERE n > 1""",
)
def p9(spark, d):
    return profile.change_rate(table(spark, d, "events").withColumnRenamed("ts", "LOAD_DATETIME"), "user_id", ["event_type", "props"])


# Contracts


CONTRACT = contract.Contract(
    [
        contract.Field("o_orderkey", ("integer",), primary_key=True),
        contract.Field("o_orderstatus", ("string",), enum=("F", "O"), mode="soft"),
        contract.Field("o_totalprice", ("number",), semantics=(contract.Semantic("max", 400000.0, "hard"), contract.Semantic("min", 1000.0, "soft"))),
        contract.Field("o_orderpriority", ("string",), semantics=(contract.Semantic("pattern", "^[1-3]", "soft"), contract.Semantic("charLength", 8, "soft"), contract.Semantic("isNotEmpty", None, "hard"), contract.Semantic("isNullThreshold", 0.1, "soft"))),
    ]
)
RULES = {
    ("o_orderkey", "not_null", "hard"): "o_orderkey IS NULL", ("o_orderkey", "type", "hard"): "false", ("o_orderstatus", "accepted_values", "soft"): "o_orderstatus NOT IN ('F', 'O')",
    ("o_totalprice", "type", "hard"): "false", ("o_totalprice", "max", "hard"): "o_totalprice > 400000", ("o_totalprice", "min", "soft"): "o_totalprice < 1000",
    ("o_orderpriority", "pattern", "soft"): "NOT regexp_matches(o_orderpriority, '^[1-3]')", ("o_orderpriority", "charLength", "soft"): "length(o_orderpriority) > 8",
    ("o_orderpriority", "isNotEmpty", "hard"): "trim(o_orderpriority) = ''", ("o_orderpriority", "isNullThreshold", "soft"): "false",
}
REPORT = " UNION ALL ".join(f"SELECT '{f}' AS field, '{r}' AS rule, '{m}' AS mode, count(*) FILTER (WHERE {b}) AS n_rows FROM orders" for (f, r, m), b in RULES.items())


@query("c1_check_not_null", "SELECT 'rare' AS column_name, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS n_rows FROM orders UNION ALL SELECT 'o_custkey', 0 AS n_rows")
def c1(spark, d):
    return contract.check_not_null(table(spark, d, "orders").withColumn("rare", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey"))), ["rare", "o_custkey"])


@query("c2_check_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def c2(spark, d):
    return contract.check_unique(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("c3_check_accepted_values", "SELECT o_orderstatus, count(*) AS n_rows FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 1")
def c3(spark, d):
    return contract.check_accepted_values(table(spark, d, "orders"), "o_orderstatus", ["F", "O"])


@query("c4_check_types", "SELECT 'o_orderpriority' AS column_name, count(*) FILTER (WHERE TRY_CAST(substr(o_orderpriority, 1, 3) AS BIGINT) IS NULL) AS n_rows FROM orders UNION ALL SELECT 'o_orderkey', 0")
def c4(spark, d):
    df = table(spark, d, "orders").withColumn("o_orderpriority", F.substring("o_orderpriority", 1, 3))
    return contract.check_types(df, {"o_orderpriority": ("integer", "null"), "o_orderkey": ("integer",)})


@query("c5_check_semantics", f"SELECT * FROM ({REPORT}) WHERE rule NOT IN ('not_null', 'type', 'accepted_values')")
def c5(spark, d):
    return contract.check_semantics(table(spark, d, "orders"), CONTRACT)


@query("c6_check_format", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders WHERE o_orderkey % 3 = 0")
def c6(spark, d):
    day = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    return contract.check_format(table(spark, d, "orders").select("o_orderkey", day.alias("day")), "day", "date")


HARD = " OR ".join(f"coalesce({b}, false)" for (_, _, m), b in RULES.items() if m == "hard")
SOFT = " || ".join(f"CASE WHEN {b} THEN ',{f}.{r}' ELSE '' END" for (f, r, m), b in RULES.items() if m == "soft")


@query("c7_route", f"SELECT o_orderkey, CASE WHEN {HARD} THEN 'quarantined' ELSE 'passed' END AS way, substr({SOFT}, 2) AS alert FROM orders")
def c7(spark, d):
    passed, quarantined = contract.route(table(spark, d, "orders"), CONTRACT)
    ways = [df.select("o_orderkey", F.lit(way).alias("way"), F.array_join("soft", ",").alias("alert")) for df, way in ((passed, "passed"), (quarantined, "quarantined"))]
    return ways[0].unionByName(ways[1])


@query("c8_contract_report", REPORT)
def c8(spark, d):
    return contract.contract_report(table(spark, d, "orders"), CONTRACT)


def fitted(c: str, key: bool) -> str:
    """SQL of the narrowest type that all values of a column of events fit."""
    t = f"CAST({c} AS VARCHAR)"
    kind = f"""CASE WHEN count({c}) = 0 THEN 'unknown' WHEN bool_and(lower({t}) IN ('true', 'false')) FILTER (WHERE {c} IS NOT NULL) THEN 'boolean'
      WHEN bool_and(regexp_full_match({t}, '[+-]?[0-9]+')) FILTER (WHERE {c} IS NOT NULL) THEN 'integer' WHEN bool_and(TRY_CAST({t} AS DOUBLE) IS NOT NULL) FILTER (WHERE {c} IS NOT NULL) THEN 'number'
      WHEN bool_and(regexp_full_match({t}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) FILTER (WHERE {c} IS NOT NULL) THEN 'date' WHEN bool_and(TRY_CAST({t} AS TIMESTAMP) IS NOT NULL) FILTER (WHERE {c} IS NOT NULL) THEN 'date-time' ELSE 'string' END"""
    return f"SELECT '{c}' AS field, {kind} AS data_type, count({c}) < count(*) AND NOT {key} AS nullable, {key} AS primary_key FROM (SELECT event_id, event_type, value, ts, NULL::VARCHAR AS nothing FROM events)"


@query("c9_draft_contract", " UNION ALL ".join(fitted(c, c == "event_id") for c in ("event_id", "event_type", "value", "ts", "nothing")))
def c9(spark, d):
    df = table(spark, d, "events").select("event_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.lit(None).cast("string").alias("nothing"))
    return contract.draft_contract(df, ["event_id"])


# Integrity


def issue_sql(severity: str, code: str, construct: str, n: str) -> str:
    return f"SELECT '{severity}' AS severity, '{code}' AS code, '{construct}' AS construct, CAST(coalesce(({n}), 0) AS BIGINT) AS n_rows"


def hub(spark, d):
    return load.load_hub([orders_stage(spark, d), customer_stage(spark, d)], None, "CUSTOMER_HK", "CUSTOMER_ID")


@query("v1_required_columns", issue_sql("error", "E_HUB_NO_BK", "hub_customer", "SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey % 11 = 0"))
def v1(spark, d):
    broken = load.load_hub(orders_stage(spark, d), None, "CUSTOMER_HK", "CUSTOMER_ID").withColumn("CUSTOMER_ID", F.when(F.col("CUSTOMER_ID") % 11 != 0, F.col("CUSTOMER_ID")))
    return integrity.required_columns(broken, "hub_customer", "hub", "CUSTOMER_HK", "CUSTOMER_ID")


@query("v2_hub_unique", issue_sql("error", "E_DUP_HUB", "hub_order", "SELECT sum(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1)"))
def v2(spark, d):
    return integrity.hub_unique(orders_stage(spark, d), "hub_order", "CUSTOMER_ID")


@query("v3_hash_collision", issue_sql("error", "E_HUB_HK_COLLISION", "hub_bucket", "SELECT count(*) FROM (SELECT 1 FROM customer GROUP BY c_custkey % 100 HAVING count(DISTINCT c_custkey) > 1)"))
def v3(spark, d):
    return integrity.hash_collision(table(spark, d, "customer").withColumn("HK", F.col("c_custkey") % 100), "hub_bucket", "HK", "c_custkey")


@query("v4_bk_collision", issue_sql("warning", "W_BK_COLLISION_RISK", "customer", "SELECT count(*) FROM customer WHERE c_custkey % 4 = 0 AND c_mktsegment <> 'OTHER'"))
def v4(spark, d):
    a = customer_stage(spark, d)
    b = a.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, "OTHER").otherwise(F.col("c_mktsegment")))
    return integrity.bk_collision(a, b, "customer", "CUSTOMER_HK", ["c_mktsegment", "c_name"])


@query("v5_link_orphans", issue_sql("error", "E_LINK_UNKNOWN_HUB", "link_order_customer.CUSTOMER_HK", "SELECT count(*) FROM orders WHERE o_custkey % 13 = 0") + " UNION ALL " + issue_sql("error", "E_LINK_UNKNOWN_HUB", "link_order_customer.ORDER_HK", "0"))
def v5(spark, d):
    orders = orders_stage(spark, d)
    link = load.load_link(orders_staged(spark, d).rows("ORDER_CUSTOMER_HK"), None, "ORDER_CUSTOMER_HK", ["ORDER_HK", "CUSTOMER_HK"])
    return integrity.link_orphans(link, "link_order_customer", {"CUSTOMER_HK": (hub(spark, d).where("CUSTOMER_ID % 13 <> 0"), "CUSTOMER_HK"), "ORDER_HK": (orders, "ORDER_HK")})


@query("v6_link_arity", issue_sql("error", "E_LINK_TOO_FEW_HUBS", "link", "SELECT count(*) FROM orders WHERE o_orderkey % 9 = 0"))
def v6(spark, d):
    return integrity.link_arity(orders_stage(spark, d).withColumn("CUSTOMER_HK", F.when(F.col("ORDER_ID") % 9 != 0, F.col("CUSTOMER_HK"))), "link", ["ORDER_HK", "CUSTOMER_HK"])


@query("v7_self_participation", issue_sql("error", "E_LINK_DUP_ROLE", "trade", "SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = o_orderkey % 25"))
def v7(spark, d):
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("other", (F.col("o_orderkey") % 25).cast("int"))
    return integrity.self_participation(joined, "trade", "c_nationkey", "other")


@query(
    "v8_redundant_grain",
    """WITH a AS (SELECT DISTINCT o_orderkey, o_custkey FROM orders), b AS (SELECT * FROM a WHERE o_orderkey % 4 > 0), n AS (SELECT count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b))
    SELECT 'warning' AS severity, 'W_LINK_REDUNDANT_GRAIN' AS code, 'link_a~link_b' AS construct, n AS n_rows, n / (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS share FROM n""",
)
def v8(spark, d):
    a = table(spark, d, "orders")
    return integrity.redundant_grain(a, a.where("o_orderkey % 4 > 0"), "link_a~link_b", ["o_orderkey", "o_custkey"])


@query("v9_txn_events", issue_sql("error", "E_TXNLINK_NO_TIMESTAMP", "lines.SHIPPED", "SELECT count(*) FROM lineitem WHERE l_linenumber = 7") + " UNION ALL " + issue_sql("error", "E_TXNLINK_NO_TIMESTAMP", "lines.ORDER_HK", "SELECT sum(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)"))
def v9(spark, d):
    return integrity.txn_events(line_stage(spark, d).withColumn("SHIPPED", F.when(F.col("l_linenumber") != 7, F.col("SHIPPED"))), "lines", "ORDER_HK", "SHIPPED")


@query("v10_sat_orphans", issue_sql("error", "E_SAT_UNKNOWN_PARENT", "sat_user", "SELECT count(*) FROM events WHERE user_id % 10 = 3"))
def v10(spark, d):
    e = events_stage(spark, d)
    parent = load.load_hub(e.where("user_id % 10 <> 3"), None, "USER_HK", "user_id")
    return integrity.sat_orphans(e, "sat_user", "USER_HK", parent, "USER_HK")


@query("v11_empty_payload", issue_sql("error", "E_SAT_NO_PAYLOAD", "sat_user", "SELECT count(*) FROM events WHERE event_id % 6 = 0"))
def v11(spark, d):
    full = F.col("event_id") % 6 != 0
    df = table(spark, d, "events").withColumns({"event_type": F.when(full, F.col("event_type")), "value": F.when(full, F.col("value"))})
    return integrity.empty_payload(df, "sat_user", ["event_type", "value"])


@query("v12_hub_without_sat", issue_sql("warning", "W_HUB_NO_SAT", "hub_customer", "SELECT count(*) FROM customer WHERE c_acctbal <= 5000 AND c_custkey % 2 = 0"))
def v12(spark, d):
    c = customer_stage(spark, d)
    return integrity.hub_without_sat(c, "hub_customer", "CUSTOMER_HK", [c.where("c_acctbal > 5000"), c.where("c_custkey % 2 = 1")])


@query("v13_duplicate_columns", "SELECT 'error' AS severity, 'E_SAT_DUP_ATTR' AS code, 'sat.c_name=other' AS construct, count(*) AS n_rows FROM customer")
def v13(spark, d):
    return integrity.duplicate_columns(table(spark, d, "customer").withColumn("other", F.col("c_name")), "sat", ["c_name", "c_mktsegment", "other", "c_custkey"])


#: Rows of 300 columns that a task has.
WIDE_ROWS = 10_000


@query(
    "v13_duplicate_columns_wide",
    """WITH n AS (SELECT count(*) AS n FROM customer), c AS (SELECT unnest(range(300)) AS i)
    SELECT 'error' AS severity, 'E_SAT_DUP_ATTR' AS code, 'sat.c' || a.i || '=c' || b.i AS construct, n AS n_rows FROM c a, c b, n WHERE a.i < b.i AND a.i % 100 = b.i % 100 AND a.i % 100 < 7""",
)
def v13_wide(spark, d):
    """300 columns, of which seven groups of three are equal."""
    c = table(spark, d, "customer").select("c_custkey")
    c = c.repartition(c.count() // WIDE_ROWS + 1)  # spread before they are made wide: a file of narrow rows is few tasks
    wide = c.select(*[(F.col("c_custkey") * (i % 100 + 1) + (0 if i % 100 < 7 else i)).alias(f"c{i}") for i in range(300)])
    return integrity.duplicate_columns(wide, "sat", wide.columns)


@query("v14_attribute_overlap", "SELECT 'warning' AS severity, 'W_SAT_ATTR_OVERLAP_CROSS_SOURCE' AS code, 'a~b.c_name' AS construct, count(*) AS n_rows FROM customer")
def v14(spark, d):
    a = customer_stage(spark, d)
    b = a.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, "OTHER").otherwise(F.col("c_mktsegment")))
    return integrity.attribute_overlap(a, b, "a~b", "CUSTOMER_HK", ["c_mktsegment", "c_name"], same_relation=False)


@query("v15_cdk_unique", issue_sql("error", "E_MASAT_NO_CDK", "lines.null", "0") + " UNION ALL " + issue_sql("error", "E_MASAT_NO_CDK", "lines.duplicate", "SELECT sum(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) ") .replace("sum(n)", "2 * sum(n)"))
def v15(spark, d):
    return integrity.cdk_unique(multi_active_staged(spark, d), "lines", "ORDER_HK", ["l_linenumber"])


@query("v16_parent_grain", issue_sql("warning", "W_MASAT_SHARED_GRAIN", "lines", "SELECT 2 * count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)"))
def v16(spark, d):
    return integrity.parent_grain(multi_active(spark, d), "lines", "ORDER_HK")


EFF = f"({islands('user_id', DAILY, hashed('user_id', '{t}') + ' AS EFF_HK, user_id, {t} AS event_type')})"


@query(
    "v17_driving_key_exclusive",
    f"""WITH eff AS (SELECT * FROM {EFF}), cur AS (SELECT * FROM eff QUALIFY row_number() OVER (PARTITION BY EFF_HK ORDER BY LOAD_DATETIME DESC, END_DATE DESC) = 1),
    o AS (SELECT count(*) AS n FROM (SELECT 1 FROM cur WHERE END_DATE = '9999-12-31 00:00:00' GROUP BY user_id HAVING count(*) > 1)),
    v AS (SELECT count(*) AS n FROM (SELECT CAST(END_DATE AS TIMESTAMP) AS e, lead(START_DATE) OVER (PARTITION BY user_id ORDER BY START_DATE, END_DATE, EFF_HK) AS s FROM cur) WHERE s < e)
    SELECT 'error' AS severity, 'E_EFFSAT_NO_DRIVING_KEY' AS code, 'eff.open' AS construct, n AS n_rows FROM o UNION ALL SELECT 'error', 'E_EFFSAT_NO_DRIVING_KEY', 'eff.overlap', n FROM v""",
)
def v17(spark, d):
    eff = load.eff_sat_from_history(daily_states(spark, d), "EFF_HK", ["user_id"], ["event_type"])
    return integrity.driving_key_exclusive(eff, "eff", "EFF_HK", ["user_id"])


@query(
    "v17_driving_key_in_link",
    issue_sql("error", "E_DRIVING_KEY_NOT_IN_LINK", "eff", f"SELECT count(*) FROM {EFF} WHERE user_id % 7 IN (0, 3)") + " UNION ALL " + issue_sql("error", "E_DRIVING_KEY_NOT_IN_LINK", "eff.event_type", f"SELECT count(*) FROM {EFF}"),
)
def v17_link(spark, d):
    """A link without the relationships of some users and with another user in those of others; and one without the column."""
    eff = load.eff_sat_from_history(daily_states(spark, d), "EFF_HK", ["user_id"], ["event_type"])
    link = eff.select("EFF_HK", "user_id").distinct().where("user_id % 7 <> 3").withColumn("user_id", F.when(F.col("user_id") % 7 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")))
    return integrity.driving_key_in_link(eff, link, "eff", "EFF_HK", ["user_id"]).unionByName(integrity.driving_key_in_link(eff, link, "eff.event_type", "EFF_HK", ["event_type"]))


@query("v18_date_order", issue_sql("error", "E_EFFSAT_DATES", "lines", "SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 2 OR o_orderkey % 50 = 0") + " UNION ALL " + issue_sql("error", "E_EFFSAT_DATE_ORDER", "lines", "SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate AND l_linenumber NOT IN (2, 3) AND o_orderkey % 50 <> 0") + " UNION ALL " + issue_sql("warning", "W_EFFSAT_DATE_ORDER_UNVERIFIED", "lines", "SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 3"))
def v18(spark, d):
    joined = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    shipped = F.when(F.col("l_linenumber") == 3, "soon").when(F.col("l_linenumber") != 2, F.col("l_shipdate").cast("string"))
    joined = joined.withColumns({"l_shipdate": shipped, "o_orderdate": F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate"))})
    return integrity.date_order(joined, "lines", "o_orderdate", "l_shipdate")


DATES = {"valid_from": "ts", "valid_to": "ts + INTERVAL 1 DAY", "seen": "TIMESTAMP '2024-01-15 00:00:00'"}


@query("v19_find_date_pairs", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS start_column, '{b}' AS end_column, avg(CAST({x} <= {y} AS INT)) AS ratio, {a == 'valid_from' and b == 'valid_to'} AS named FROM events" for a, x in DATES.items() for b, y in DATES.items() if a != b) + ") WHERE ratio >= 0.99")
def v19(spark, d):
    df = table(spark, d, "events").select(F.col("ts").alias("valid_from"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("valid_to"), F.lit("2024-01-15").cast("timestamp").alias("seen"))
    return integrity.find_date_pairs(df, ["valid_from", "valid_to", "seen"])


@query("v20_duplicate_feeds", "SELECT 'error' AS severity, 'E_HUB_DUP_FEED' AS code, 'hub_customer' AS construct, count(DISTINCT o_custkey) AS n_rows FROM orders")
def v20(spark, d):
    a = orders_stage(spark, d)
    return integrity.duplicate_feeds(a, a.where("ORDER_ID IS NOT NULL"), "hub_customer", "CUSTOMER_ID")


@query("v21_feeds_integrate", issue_sql("error", "E_HUB_HK_COLLISION", "hub_customer", "SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 17 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)"))
def v21(spark, d):
    bad = customer_stage(spark, d).withColumn("CUSTOMER_HK", F.when(F.col("CUSTOMER_ID") % 17 == 0, F.lit("x")).otherwise(F.col("CUSTOMER_HK")))
    return integrity.feeds_integrate(orders_stage(spark, d), bad, "hub_customer", "CUSTOMER_HK", "CUSTOMER_ID")


REPORTED = ("v2_hub_unique", "v3_hash_collision", "v4_bk_collision", "v5_link_orphans", "v6_link_arity", "v7_self_participation", "v9_txn_events", "v10_sat_orphans", "v11_empty_payload", "v12_hub_without_sat", "v15_cdk_unique", "v16_parent_grain", "v18_date_order", "v20_duplicate_feeds", "v21_feeds_integrate")
ISSUES = " UNION ALL ".join(f"SELECT severity, code, construct, n_rows FROM ({ORACLES[n]})" for n in REPORTED)


@query("v22_integrity_report", f"WITH i AS ({ISSUES}) SELECT severity, code, construct, CAST(sum(n_rows) AS BIGINT) AS n_rows, NOT (SELECT bool_or(severity = 'error') FROM i WHERE n_rows > 0) AS passed FROM i WHERE n_rows > 0 GROUP BY ALL")
def v22(spark, d):
    return integrity.integrity_report([QUERIES[n](spark, d) for n in REPORTED])


# Matching

NORM = "upper(trim(regexp_replace({c}, '[^0-9a-zA-Z]+', '_', 'g'), '_'))"
STOP = "('THE', 'A', 'AN', 'OF', 'ID', 'NR', 'NO', 'DOC')"


@query(
    "m1_match_labels",
    f"""WITH a AS (SELECT p_partkey AS id, {NORM.format(c='p_type')} AS label FROM part), b AS (SELECT p_partkey AS id, {NORM.format(c="CASE WHEN p_size % 5 = 0 THEN p_type || ' ' || p_brand ELSE replace(p_type, ' ', '--') END")} AS label FROM part),
    na AS (SELECT label, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT label, count(*) AS n FROM b GROUP BY 1)
    SELECT 'a' AS side, id, label, n AS n_partners FROM a JOIN nb USING (label) UNION ALL SELECT 'b', id, label, n FROM b JOIN na USING (label)""",
)
def m1(spark, d):
    p = table(spark, d, "part")
    other = F.when(F.col("p_size") % 5 == 0, F.concat_ws(" ", "p_type", "p_brand")).otherwise(F.replace("p_type", F.lit(" "), F.lit("--")))
    return match.match_labels(p, p.withColumn("p_type", other), "p_partkey", "p_type", "p_partkey", "p_type")


@query(
    "m2_match_tokens",
    f"""WITH d AS (SELECT DISTINCT doc_id, unnest(string_split({NORM.format(c='text')}, '_')) AS t FROM documents), b AS (SELECT DISTINCT item_id, unnest(string_split({NORM.format(c='text')}, '_')) AS t FROM benchmark),
    dd AS (SELECT * FROM d WHERE length(t) >= 2 AND t NOT IN {STOP}), bb AS (SELECT * FROM b WHERE length(t) >= 2 AND t NOT IN {STOP})
    SELECT doc_id AS a_id, item_id AS b_id, count(*) AS n_shared FROM dd JOIN bb USING (t) GROUP BY 1, 2 HAVING count(*) >= 15""",
)
def m2(spark, d):
    return match.match_tokens(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text", least=15)


@query(
    "m3_tier",
    f"""WITH p AS ({CUSTOMER_PROFILE}), c AS (SELECT * FROM (VALUES ('c custkey', 'c_custkey', '', 'business_key'), ('customer name', 'c_name', 'Full name of customer', 'attribute'), ('client', 'c_custkey', NULL, 'business_key'), ('branch', 'c_nationkey', 'Nation', 'business_key')) v(concept, column_name, comment, kind))
    SELECT concept, column_name, CASE WHEN concept = 'c custkey' THEN 'exact_name' WHEN concept = 'customer name' THEN 'comment_grounded' WHEN kind = 'business_key' AND uniqueness_ratio >= 0.95 AND null_ratio <= 0.05 THEN 'profiled_key' ELSE 'other' END AS tier FROM c JOIN p USING (column_name)""",
)
def m3(spark, d):
    c = spark.createDataFrame([("c custkey", "c_custkey", "", "business_key"), ("customer name", "c_name", "Full name of customer", "attribute"), ("client", "c_custkey", None, "business_key"), ("branch", "c_nationkey", "Nation", "business_key")], "concept string, column_name string, comment string, kind string")
    return match.tier(c, p1(spark, d)).select("concept", "column_name", "tier")


@query(
    "m4_triage",
    """WITH c AS (SELECT doc_id AS item, doc_id AS target FROM labels UNION ALL SELECT doc_id, doc_id + 1 FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id + 100000000, -1 FROM labels WHERE doc_id % 2 = 0),
    i AS (SELECT doc_id AS item FROM documents UNION SELECT doc_id + 100000000 FROM labels WHERE doc_id % 2 = 0),
    n AS (SELECT item, count(DISTINCT target) AS n, min(target) AS t, count(*) FILTER (WHERE target IN (SELECT doc_id FROM documents)) AS k FROM c GROUP BY item)
    SELECT i.item, CASE WHEN n IS NULL THEN 'gap' WHEN n = 1 AND k > 0 THEN 'mapped' ELSE 'unresolved' END AS outcome, CASE WHEN n = 1 AND k > 0 THEN t END AS target FROM i LEFT JOIN n USING (item)""",
)
def m4(spark, d):
    lab, docs = table(spark, d, "labels"), table(spark, d, "documents").select(F.col("doc_id").alias("item"))
    c = lab.select(F.col("doc_id").alias("item"), F.col("doc_id").alias("target")).union(lab.where("doc_id % 3 = 0").select("doc_id", F.col("doc_id") + 1)).union(lab.where("doc_id % 2 = 0").select(F.col("doc_id") + 100000000, F.lit(-1).cast("long")))
    items = docs.union(lab.where("doc_id % 2 = 0").select((F.col("doc_id") + 100000000).alias("item")))
    return match.triage(items, c, docs.select(F.col("item").alias("target")))


@query(
    "m4_triage_by_entity",
    """WITH c AS (SELECT o_orderpriority AS label, o_orderstatus AS entity, o_orderkey AS target FROM orders WHERE o_orderkey % 100 = 7),
    i AS (SELECT DISTINCT o_orderpriority AS label, o_orderstatus AS entity FROM orders), n AS (SELECT label, entity, count(DISTINCT target) AS n, min(target) AS t FROM c GROUP BY ALL)
    SELECT i.label, i.entity, CASE WHEN n IS NULL THEN 'gap' WHEN n = 1 THEN 'mapped' ELSE 'unresolved' END AS outcome, CASE WHEN n = 1 THEN t END AS target FROM i LEFT JOIN n USING (label, entity)""",
)
def m4_entity(spark, d):
    """Equal labels of several entities are several concepts."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("entity"), F.col("o_orderkey").alias("target"))
    return match.triage(o, o.where("target % 100 = 7"), o, item=["label", "entity"])


def keys_long(spark, d):
    def one(name, column):
        return table(spark, d, name).select(F.lit(name).alias("source"), F.lit(column).alias("column"), F.col(column).cast("string").alias("value"))

    frames = [one("customer", "c_custkey"), one("orders", "o_custkey"), one("orders", "o_orderkey"), one("lineitem", "l_orderkey"), one("supplier", "s_suppkey"), one("lineitem", "l_suppkey")]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("m5_anchor_column", "SELECT 'customer' AS source, 'c_custkey' AS \"column\" WHERE (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) = 0")
def m5(spark, d):
    return match.anchor_column(keys_long(spark, d).where("column = 'c_custkey' OR column = 'o_custkey' AND value % 2 = 0"))


@query("m6_containment", "WITH v AS (SELECT DISTINCT l_suppkey AS v FROM lineitem) SELECT count(*) AS n_values, count(*) FILTER (WHERE v IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 > 0)) AS n_found, n_found / n_values AS containment FROM v")
def m6(spark, d):
    return match.containment(table(spark, d, "lineitem"), "l_suppkey", table(spark, d, "supplier").where("s_suppkey % 3 > 0"), "s_suppkey")


STAR = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "events": ["event_id", "user_id"],
}


def star_values() -> str:
    return " UNION ".join(f"SELECT '{t}' AS source, '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL" for t, columns in STAR.items() for c in columns)


@query(
    "m6_contained_columns",
    f"""WITH v AS ({star_values()}), n AS (SELECT source, col, count(*) AS n_child FROM v GROUP BY ALL)
    SELECT a.source AS child_source, a.col AS child_column, b.source AS parent_source, b.col AS parent_column, count(*) AS n_shared, any_value(n_child) AS n_child, count(*) / any_value(n_child) AS containment
    FROM v a JOIN v b ON a.v = b.v AND (a.source <> b.source OR a.col <> b.col) JOIN n ON n.source = a.source AND n.col = a.col GROUP BY 1, 2, 3, 4 HAVING count(*) >= 0.9 * any_value(n_child)""",
)
def m6_columns(spark, d):
    """Of all key columns of the star schema, those whose values another column holds."""
    def cells(name, columns):
        cell = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
        return table(spark, d, name).select(F.lit(name).alias("source"), cell.alias("x")).select("source", "x.*")

    parts = [cells(t, c) for t, c in STAR.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return match.contained_columns(out, 0.9)


NORM_NAME = "upper(trim(regexp_replace({c}, '[^0-9a-zA-Z]+', '_', 'g'), '_'))"


@query(
    "m7_propose_links",
    f"""WITH fk AS (SELECT * FROM (VALUES ('fk1', ['o_custkey'], 'customer', ['c_custkey']), ('fk2', ['l_orderkey'], 'orders', ['o_orderkey']), ('fk3', ['l_partkey', 'l_suppkey'], 'partsupp', ['ps_partkey', 'ps_suppkey']), ('fk4', ['c_nationkey'], 'nation', ['n_nationkey']), ('fk5', ['l_suppkey'], 'supplier', ['s_suppkey']), ('fk6', ['l_partkey'], 'part', ['p_partkey'])) v(fk, cols, ref_table, refs)),
    hub AS (SELECT * FROM (VALUES ('hub_buyer', 'c_custkey'), ('hub_order', 'o_orderkey'), ('hub_supplier', 's_suppkey'), ('hub_vendor', 'S-SUPPKEY'), ('hub_x', 'P-PARTKEY'), ('hub_y', 'p_partkey')) v(hub, k)),
    c AS (SELECT 'fk1' AS fk, count(DISTINCT o_custkey) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM customer)) / count(DISTINCT o_custkey) AS share FROM orders
      UNION ALL SELECT 'fk2', count(DISTINCT l_orderkey) FILTER (WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) / count(DISTINCT l_orderkey) FROM lineitem
      UNION ALL SELECT 'fk5', count(DISTINCT l_suppkey) FILTER (WHERE l_suppkey IN (SELECT s_suppkey FROM supplier)) / count(DISTINCT l_suppkey) FROM lineitem),
    n AS (SELECT fk.*, count(hub) AS n, min(hub) AS only_hub, min(hub) FILTER (WHERE 'hub_' || ref_table = hub) AS named, count(hub) FILTER (WHERE 'hub_' || ref_table = hub) AS m FROM fk LEFT JOIN hub ON {NORM_NAME.format(c='refs[1]')} = {NORM_NAME.format(c='k')} GROUP BY ALL),
    r AS (SELECT *, CASE WHEN len(cols) <> 1 THEN 'composite_key' WHEN n = 0 THEN 'no_hub_for_key' WHEN n > 1 AND m <> 1 THEN 'ambiguous_hub' END AS reason, CASE WHEN n = 1 THEN only_hub ELSE named END AS hub FROM n)
    SELECT r.fk, CASE WHEN reason IS NULL THEN hub END AS hub, coalesce(reason, CASE WHEN {NORM_NAME.format(c='cols[1]')} = {NORM_NAME.format(c='refs[1]')} THEN 'same_name' ELSE 'renamed' END) AS outcome, CASE WHEN reason IS NULL THEN coalesce(share, 0) END AS containment
    FROM r LEFT JOIN c ON r.fk = c.fk""",
)
def m7(spark, d):
    fks = spark.createDataFrame(
        [("fk1", "orders", ["o_custkey"], "customer", ["c_custkey"]), ("fk2", "lineitem", ["l_orderkey"], "orders", ["o_orderkey"]), ("fk3", "lineitem", ["l_partkey", "l_suppkey"], "partsupp", ["ps_partkey", "ps_suppkey"]), ("fk4", "customer", ["c_nationkey"], "nation", ["n_nationkey"]), ("fk5", "lineitem", ["l_suppkey"], "supplier", ["s_suppkey"]), ("fk6", "lineitem", ["l_partkey"], "part", ["p_partkey"])],
        "fk string, table string, columns array<string>, ref_table string, ref_columns array<string>",
    )
    hubs = spark.createDataFrame([("hub_buyer", "c_custkey"), ("hub_order", "o_orderkey"), ("hub_supplier", "s_suppkey"), ("hub_vendor", "S-SUPPKEY"), ("hub_x", "P-PARTKEY"), ("hub_y", "p_partkey")], "hub string, key string")
    return match.propose_links(fks, hubs, keys_long(spark, d))


@query(
    "m8_resolve_entities",
    """WITH k AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS v FROM customer), l AS (
      SELECT 'orders' AS source, 'o_custkey' AS col, CAST(o_custkey AS VARCHAR) AS v FROM orders UNION SELECT 'orders', 'ref', 'R' || o_orderkey FROM orders UNION SELECT 'part', 'p_partkey', 'P' || p_partkey FROM part
      UNION SELECT 'old', 'alt', CAST(CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE -c_custkey - 1 END AS VARCHAR) FROM customer),
    s AS (SELECT source, col, count(*) FILTER (WHERE v IN (SELECT v FROM k)) / count(*) AS overlap FROM l GROUP BY ALL), x AS (SELECT source, min(col) AS col FROM s WHERE overlap >= 0.95 GROUP BY 1)
    SELECT s.source, s.col AS "column", CASE WHEN overlap >= 0.95 THEN 'exact_key' WHEN x.col <> s.col THEN 'key_overlap' WHEN overlap <= 0.05 THEN 'NEW' ELSE 'unresolved' END AS resolution,
      CASE WHEN overlap >= 0.95 OR x.col <> s.col THEN 'hub_customer' END AS hub, overlap FROM s LEFT JOIN x ON s.source = x.source""",
)
def m8(spark, d):
    def rows(df, source, column, value):
        return df.select(F.lit(source).alias("source"), F.lit(column).alias("column"), value.cast("string").alias("value"))

    o, p, c = table(spark, d, "orders"), table(spark, d, "part"), table(spark, d, "customer")
    long = rows(o, "orders", "o_custkey", F.col("o_custkey")).unionByName(rows(o, "orders", "ref", F.concat(F.lit("R"), F.col("o_orderkey")))).unionByName(rows(p, "part", "p_partkey", F.concat(F.lit("P"), F.col("p_partkey"))))
    long = long.unionByName(rows(c, "old", "alt", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(-F.col("c_custkey") - 1)))
    return match.resolve_entities(long, c.select(F.lit("hub_customer").alias("hub"), F.col("c_custkey").cast("string").alias("value")))


@query(
    "m9_key_value_overlap",
    """WITH a AS (SELECT DISTINCT user_id AS v FROM events), b AS (SELECT DISTINCT c_custkey AS v FROM customer), i AS (SELECT (SELECT count(*) FROM a) AS n_new, (SELECT count(*) FROM b) AS n_hub, count(*) AS n_both FROM a JOIN b USING (v))
    SELECT n_new, n_hub, n_both, n_both / (n_new + n_hub - n_both) AS jaccard, n_both / n_new AS new_in_hub, n_both / n_hub AS hub_in_new FROM i""",
)
def m9(spark, d):
    return match.key_value_overlap(table(spark, d, "events"), "user_id", table(spark, d, "customer"), "c_custkey")


@query("m10_same_as_candidates", "SELECT DISTINCT o_orderkey AS a, o_custkey AS b FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def m10(spark, d):
    o = table(spark, d, "orders")
    return match.same_as_candidates(o, "o_orderkey", "o_custkey", o.where("o_orderkey % 2 = 0"), "o_orderkey", table(spark, d, "customer").where("c_acctbal > 0"), "c_custkey")


@query("m11_dedupe_first", f"SELECT p_partkey, p_type, CAST(n AS BIGINT) AS n_dropped FROM (SELECT *, count(*) OVER (PARTITION BY {NORM.format(c='p_type')}) - 1 AS n FROM part QUALIFY row_number() OVER (PARTITION BY {NORM.format(c='p_type')} ORDER BY p_partkey) = 1)")
def m11(spark, d):
    return match.dedupe_first(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", "p_partkey")


@query(
    "m12_overlay_decisions",
    """WITH n AS (SELECT o_custkey AS ref, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -o_orderkey ELSE o_custkey END AS ref, o_orderpriority AS answer FROM orders)
    SELECT o_orderkey, ref, CASE WHEN ref % 5 = 0 AND count(*) OVER (PARTITION BY ref) = 1 THEN 'reviewed' ELSE answer END AS answer,
      CASE WHEN ref % 5 <> 0 THEN 'accepted' WHEN count(*) OVER (PARTITION BY ref) = 1 THEN 'overridden' ELSE 'ambiguous' END AS status FROM x""",
)
def m12(spark, d):
    ref = F.when(F.col("o_orderkey") % 2 == 0, -F.col("o_orderkey")).otherwise(F.col("o_custkey"))
    proposals = table(spark, d, "orders").select("o_orderkey", ref.alias("ref"), F.col("o_orderpriority").alias("answer"))
    decisions = proposals.where("ref % 5 = 0").select("ref", F.lit("reviewed").alias("answer"))
    return match.overlay_decisions(proposals, decisions, "o_orderkey", "ref", "answer")


# Extension


@query("x1_add_feed", f"WITH {ORDERS}, {CUSTOMERS} SELECT CUSTOMER_HK, CUSTOMER_ID, min(LOAD_DATETIME) AS LOAD_DATETIME, 'orders' AS RECORD_SOURCE FROM o WHERE CUSTOMER_ID % 2 = 0 GROUP BY 1, 2 UNION ALL SELECT CUSTOMER_HK, CUSTOMER_ID, LOAD_DATETIME, RECORD_SOURCE FROM c WHERE CUSTOMER_ID NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 2 = 0)")
def x1(spark, d):
    live = load.load_hub(orders_stage(spark, d).where("CUSTOMER_ID % 2 = 0"), None, "CUSTOMER_HK", "CUSTOMER_ID")
    return extend.add_feed(live, customer_stage(spark, d), "CUSTOMER_HK", "CUSTOMER_ID")


@query("x2_diff_tables", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'removed' WHEN c_custkey % 10 = 1 THEN 'changed' WHEN c_custkey % 10 = 2 THEN 'new' ELSE 'unchanged' END AS status FROM customer")
def x2(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    after = c.where("c_custkey % 10 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 1, F.lit(None)).otherwise(F.col("c_mktsegment")))
    return extend.diff_tables(c.where("c_custkey % 10 <> 2"), after, ["c_custkey"])


@query(
    "x2_diff_extended",
    """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'removed' WHEN c_custkey % 10 = 1 THEN 'changed' WHEN c_custkey % 10 = 2 THEN 'new' WHEN rich OR late THEN 'extended' ELSE 'unchanged' END AS status,
      CASE WHEN rich AND late THEN 'feed_rich,sat_late' WHEN rich THEN 'feed_rich' WHEN late THEN 'sat_late' ELSE '' END AS gained
    FROM (SELECT c_custkey, c_acctbal > 5000 AS rich, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01 00:00:00') AS late FROM customer)""",
)
def x2_extended(spark, d):
    """Keys that an extension has only added a feed or a satellite to are extended."""
    c = table(spark, d, "customer")
    rows = c.select("c_custkey", "c_name", "c_mktsegment")
    after = rows.where("c_custkey % 10 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 1, F.lit(None)).otherwise(F.col("c_mktsegment")))
    late = table(spark, d, "orders").where("o_orderdate >= '2001-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    late = late.join(c, "c_custkey", "left_semi")
    return extend.diff_tables(rows.where("c_custkey % 10 <> 2"), after, ["c_custkey"], {"feed_rich": c.where("c_acctbal > 5000"), "sat_late": late})


def hashed_customers(spark, d):
    """A table of customers kept by hash buckets, before and after some of its keys change."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    paths = [shared_folder(spark), shared_folder(spark)]
    extend.append_hashed(c.where("c_custkey % 97 <> 2"), paths[0], ["c_custkey"], 64)
    after = c.where("c_custkey % 97 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 97 == 1, F.lit(None)).otherwise(F.col("c_mktsegment")))
    for half in (0, 1):  # in two loads
        extend.append_hashed(after.where(F.col("c_custkey") % 2 == half), paths[1], ["c_custkey"], 64)
    return paths


@query("x2_diff_hashed", "SELECT c_custkey, CASE c_custkey % 97 WHEN 0 THEN 'removed' WHEN 1 THEN 'changed' ELSE 'new' END AS status FROM customer WHERE c_custkey % 97 <= 2")
def x2_hashed(spark, d):
    return extend.diff_hashed(spark, *hashed_customers(spark, d), ["c_custkey"])


@query("x4_preserved_hashed", "SELECT count(*) AS n_before, count(*) FILTER (WHERE c_custkey % 97 > 1) AS n_kept, n_kept / n_before AS score FROM customer WHERE c_custkey % 97 <> 2")
def x4_hashed(spark, d):
    return extend.preserved_hashed(spark, *hashed_customers(spark, d))


MARKED = "coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '^')"
ORDER_TEXT = " || ".join(MARKED.format(c=c) for c in ("o_orderkey", "o_custkey", "nullif(o_orderstatus, 'F')", "CAST(o_totalprice AS DECIMAL(18,2))", "o_orderdate"))


@query("x3_content_hash", f"SELECT count(*) AS n_rows, CAST(sum(('0x' || substr(md5({ORDER_TEXT}), 1, 15))::BIGINT) AS VARCHAR) AS fingerprint FROM orders")
def x3(spark, d):
    o = table(spark, d, "orders")
    return extend.content_hash(o.select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"), "o_orderdate"))


@query("x4_preserved", "SELECT count(*) AS n_before, count(*) FILTER (WHERE c_custkey % 10 <> 1) AS n_kept, n_kept / n_before AS score FROM customer")
def x4(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return extend.preserved(c, c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 1, F.lit("MOVED")).otherwise(F.col("c_mktsegment"))))


def existing_sql(construct: str, code: str, gone: str, changed: str) -> str:
    return issue_sql("error", "E_EXISTING_REMOVED", construct, gone) + " UNION ALL " + issue_sql("error", code, construct, changed)


@query(
    "x4_existing_changes",
    " UNION ALL ".join(
        (
            existing_sql("hub_customer", "E_EXISTING_BK_CHANGED", "SELECT count(*) FROM customer WHERE c_custkey % 10 = 0", "SELECT count(*) FROM customer WHERE c_custkey % 10 = 1"),
            existing_sql("link_order_customer", "E_EXISTING_GRAIN_CHANGED", "0", "SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0"),
            existing_sql("sat_customer", "E_EXISTING_SAT_RESHAPED", "0", "SELECT count(*) FROM customer WHERE c_custkey % 6 = 0"),
            existing_sql("sat_widened", "E_EXISTING_SAT_RESHAPED", "0", "SELECT count(*) FROM customer"),
        )
    ),
)
def x4_changes(spark, d):
    """A hub with removed rows and other business keys, a link with other participations, satellites with
    other values and with one more column."""
    c, o = customer_stage(spark, d), orders_stage(spark, d).select("ORDER_CUSTOMER_HK", "ORDER_HK", "CUSTOMER_HK")
    hub_columns = c.select("CUSTOMER_HK", "CUSTOMER_ID")
    moved = hub_columns.where("CUSTOMER_ID % 10 <> 0").withColumn("CUSTOMER_ID", F.when(F.col("CUSTOMER_ID") % 10 == 1, -F.col("CUSTOMER_ID")).otherwise(F.col("CUSTOMER_ID")))
    other = orders_stage(spark, d).withColumn("CUSTOMER_HK", F.when(F.col("ORDER_ID") % 7 == 0, F.lit("x")).otherwise(F.col("CUSTOMER_HK"))).select(o.columns)
    sat = c.select("CUSTOMER_HK", "c_custkey", "c_mktsegment")
    reshaped = sat.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 6 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")))
    parts = [
        extend.existing_changes(hub_columns, moved, "hub_customer", "hub", ["CUSTOMER_HK"], ["CUSTOMER_ID"]),
        extend.existing_changes(o, other, "link_order_customer", "link", ["ORDER_CUSTOMER_HK"], ["ORDER_HK", "CUSTOMER_HK"]),
        extend.existing_changes(sat, reshaped, "sat_customer", "satellite", ["CUSTOMER_HK"], ["c_mktsegment"]),
        extend.existing_changes(sat, sat.withColumn("more", F.lit(1)), "sat_widened", "satellite", ["CUSTOMER_HK"], ["c_mktsegment"]),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("x5_cross_domain_links", f"SELECT {hashed('o_orderkey', 'o_custkey')} AS ORDER_CUSTOMER_HK, 'orders' AS ORDER_HK_ORIGIN, 'customer' AS CUSTOMER_HK_ORIGIN FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING min(o_orderdate) > TIMESTAMP '1996-06-01 00:00:00') AND o_custkey IN (SELECT c_custkey FROM customer)")
def x5(spark, d):
    orders = orders_stage(spark, d)
    link = load.load_link(orders, None, "ORDER_CUSTOMER_HK", ["ORDER_HK", "CUSTOMER_HK"])
    order_hub = load.load_hub(orders, None, "ORDER_HK", "ORDER_ID")
    first = union_feeds([load.load_hub(s, None, "CUSTOMER_HK", "CUSTOMER_ID") for s in (orders, customer_stage(spark, d))])
    return extend.cross_domain_links(link, {"ORDER_HK": (order_hub, "ORDER_HK"), "CUSTOMER_HK": (first, "CUSTOMER_HK")}).select("ORDER_CUSTOMER_HK", "ORDER_HK_ORIGIN", "CUSTOMER_HK_ORIGIN")


# Scores: candidate matches made from the tables


def pairs(spark, d):
    """Found and golden pairs by kind: order and customer, where some are wrong or missing."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"))
    return o.where("a % 5 <> 0").withColumn("b", F.when(F.col("a") % 7 == 0, F.col("b") + 1).otherwise(F.col("b"))), o.where("a % 3 <> 0")


F1 = """WITH g AS (SELECT DISTINCT o_orderpriority AS kind, o_orderkey AS a, o_custkey AS b FROM orders WHERE o_orderkey % 3 <> 0), f AS (SELECT DISTINCT o_orderpriority AS kind, o_orderkey AS a, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS b FROM orders WHERE o_orderkey % 5 <> 0),
  n AS (SELECT kind, (SELECT count(*) FROM f WHERE f.kind = g.kind) AS n_found, count(*) AS n_golden, (SELECT count(*) FROM f WHERE f.kind = g.kind AND (a, b) IN (SELECT (a, b) FROM g)) AS n_both FROM g GROUP BY kind)
  SELECT *, n_both / n_found AS precision, n_both / n_golden AS recall, 2.0::DOUBLE * n_both / (n_found + n_golden) AS f1 FROM n"""


@query("e1_set_f1", F1)
def e1(spark, d):
    found, golden = pairs(spark, d)
    return score.set_f1(found, golden, ["a", "b"])


@query("e1_mean_f1", f"SELECT avg(f1) AS mean_f1, count(*) AS n_kinds FROM ({F1})")
def e1_mean(spark, d):
    return score.mean_f1(e1(spark, d))


def groups(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("name"), F.col("l_suppkey").cast("string").alias("member"))
    return li, li.withColumn("name", F.when(F.col("name") % 2 == 0, F.concat(F.lit("G"), F.col("name"))).otherwise(F.concat(F.col("name"), F.lit(" -"))))


GROUPS = """WITH a AS (SELECT CAST(l_orderkey AS VARCHAR) AS name, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS m FROM lineitem GROUP BY 1),
  b AS (SELECT CASE WHEN CAST(name AS BIGINT) % 2 = 0 THEN 'G' || name ELSE name || ' -' END AS name, m FROM a), n AS (SELECT m, count(*) AS n, min(name) AS sole FROM a GROUP BY m)"""


@query("e2_match_groups", f"{GROUPS} SELECT CASE WHEN n = 1 THEN sole ELSE a.name END AS found_name, b.name AS golden_name FROM b JOIN n USING (m) LEFT JOIN a ON a.m = b.m AND a.name || ' -' = b.name WHERE n = 1 OR a.name IS NOT NULL")
def e2(spark, d):
    return score.match_groups(*groups(spark, d))


@query(
    "e3_group_set_accuracy",
    """WITH g AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), f AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber < 5 GROUP BY 1)
    SELECT count(*) AS n_groups, count(*) FILTER (WHERE g.k % 5 <> 0 AND f.s = g.s) AS n_right, n_right / n_groups AS accuracy FROM g LEFT JOIN f USING (k)""",
)
def e3(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag = 'A'").select("l_linenumber", F.col("l_orderkey").cast("string").alias("name"), F.col("l_suppkey").cast("string").alias("element"))
    matched = table(spark, d, "lineitem").where("l_orderkey % 5 <> 0").select(F.col("l_orderkey").cast("string").alias("found_name")).distinct().withColumn("golden_name", F.col("found_name"))
    return score.group_set_accuracy(matched, li.where("l_linenumber < 5"), li)


def mapping(spark, d):
    """Proposals, golden bindings and gaps of concepts (customers, by order status as their entity) to
    columns (orders)."""
    o = table(spark, d, "orders").select(F.concat(F.lit("c "), F.col("o_custkey")).alias("concept"), F.col("o_orderstatus").alias("entity"), F.col("o_orderpriority").alias("table"), F.col("o_orderkey").cast("string").alias("column"), (F.col("o_orderkey") % 100 / 100.0).alias("confidence"))
    last = F.right("concept", F.lit(1))
    return o.where("column % 4 <> 0"), o.where((F.col("column") % 3 != 0) & ~last.isin("7", "8")), o.where(last == "8").select("concept", "entity")


MAPPING = """WITH o AS (SELECT 'c ' || o_custkey AS concept, o_orderstatus AS entity, o_orderpriority AS t, o_orderkey AS k, (o_orderkey % 100) / 100.0 AS confidence FROM orders),
  g AS (SELECT * FROM o WHERE k % 3 <> 0 AND right(concept, 1) NOT IN ('7', '8')), u AS (SELECT concept, entity FROM g UNION SELECT concept, entity FROM o WHERE right(concept, 1) = '8'),
  p AS (SELECT *, k IN (SELECT k FROM g) AS r FROM o WHERE k % 4 <> 0 AND (concept, entity) IN (SELECT (concept, entity) FROM u))"""


@query(
    "e4_mapping_accuracy",
    MAPPING + """, n AS (SELECT count(*) AS n_proposed, (SELECT count(DISTINCT (concept, entity)) FROM g) AS n_golden, count(*) FILTER (WHERE r) AS n_right, count(DISTINCT (concept, entity)) FILTER (WHERE r) AS n_concepts FROM p)
    SELECT *, 2.0::DOUBLE * (n_right / n_proposed) * (n_concepts / n_golden) / (n_right / n_proposed + n_concepts / n_golden) AS f1 FROM n""",
)
def e4(spark, d):
    return score.mapping_accuracy(*mapping(spark, d))


@query("e5_gap_recall", """WITH g AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 6 = 0) SELECT count(*) AS n_golden, count(*) FILTER (WHERE k % 4 = 0) AS n_found,
  count(*) FILTER (WHERE k IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0)) AS n_forced, n_found / n_golden AS recall FROM g""")
def e5(spark, d):
    def concepts(df, c):
        return df.select(F.concat(F.lit("c "), F.col(c)).alias("concept"))

    c = table(spark, d, "customer")
    return score.gap_recall(concepts(c.where("c_custkey % 4 = 0"), "c_custkey"), concepts(table(spark, d, "orders").where("o_orderkey % 20 = 0"), "o_custkey"), concepts(c.where("c_custkey % 6 = 0"), "c_custkey"))


@query("e6_mapping_coverage", MAPPING + " SELECT count(*) AS n_golden, count(*) FILTER (WHERE bound) AS n_found, n_found / n_golden AS coverage FROM (SELECT bool_or(k % 4 <> 0) AS bound FROM g GROUP BY concept, entity)")
def e6(spark, d):
    proposals, golden, _ = mapping(spark, d)
    return score.mapping_coverage(proposals, golden)


@query("e7_false_friend_hits", "SELECT count(*) AS n_hits, (CASE WHEN count(*) = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 9 = 0")
def e7(spark, d):
    proposals, _, _ = mapping(spark, d)
    bad = table(spark, d, "orders").where("o_orderkey % 9 = 0").select(F.col("o_orderpriority").alias("table"), F.col("o_orderkey").cast("string").alias("column"))
    return score.false_friend_hits(proposals, bad)


@query("e8_calibration", MAPPING + " SELECT count(*) FILTER (WHERE r) AS n_right, count(*) FILTER (WHERE NOT r) AS n_wrong, round(greatest(0.0, least(1.0, avg(confidence) FILTER (WHERE r) - avg(confidence) FILTER (WHERE NOT r))), 9) AS margin FROM p")
def e8(spark, d):
    return score.calibration(*mapping(spark, d)).withColumn("margin", F.round("margin", 9))


def resolutions(spark, d):
    """Answers and golden answers of keys (customers): new, same as another hub, or a segment's hub; some
    are wrong, unresolved, of another same-as target, missing, or given twice."""
    k = F.col("c_custkey")
    kind = F.when(k % 4 == 0, "NEW").when(k % 10 == 1, "same_as_candidate").otherwise(F.col("c_mktsegment"))
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("K-"), k).alias("key"), kind.alias("resolution"), F.when(k % 10 == 1, F.lit("hub_x")).alias("same_as"))
    got = F.when(k % 9 == 0, "WRONG").when(k % 13 == 0, "unresolved").otherwise(F.col("resolution"))
    spelled = F.when(k % 2 == 0, F.concat(F.lit("partner::k_"), k, F.lit(" (national number)"))).otherwise(F.concat(F.lit("k "), k))
    found = c.withColumns({"key": spelled, "resolution": got, "same_as": F.when(k % 3 == 0, F.lit("hub_y")).otherwise(F.col("same_as"))}).where("c_custkey % 8 <> 5")
    twice = found.where("c_custkey % 22 = 0").withColumn("resolution", F.lit("unresolved"))
    return found.unionByName(twice), c.where("c_custkey % 2 = 0 OR c_custkey % 10 = 1")


RES = """WITH g AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'NEW' WHEN c_custkey % 10 = 1 THEN 'same_as_candidate' ELSE c_mktsegment END AS want, CASE WHEN c_custkey % 10 = 1 THEN 'hub_x' END AS want_as FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 10 = 1),
  a AS (SELECT k, CASE WHEN k % 9 = 0 THEN 'WRONG' WHEN k % 13 = 0 THEN 'unresolved' ELSE want END AS got, CASE WHEN k % 3 = 0 THEN 'hub_y' ELSE want_as END AS got_as FROM g WHERE k % 8 <> 5),
  r AS (SELECT * FROM a UNION ALL SELECT k, 'unresolved', got_as FROM a WHERE k % 22 = 0),
  m AS (SELECT g.k, want, bool_and(got IS NOT DISTINCT FROM want) AS same, bool_and(got IS NOT DISTINCT FROM want AND (want <> 'same_as_candidate' OR got_as IS NOT DISTINCT FROM want_as)) AS ok FROM g LEFT JOIN r USING (k) GROUP BY ALL)"""


@query("e9_false_merge_rate", RES + " SELECT count(*) AS n_merges, count(*) FILTER (WHERE got <> want) AS n_false, (CASE WHEN n_false > 0 THEN 0.0 ELSE 1.0 END)::DOUBLE AS score FROM g JOIN r USING (k) WHERE got NOT IN ('NEW', 'same_as_candidate', 'unresolved')")
def e9(spark, d):
    return score.false_merge_rate(*resolutions(spark, d))


@query("e10_resolution_accuracy", RES + " SELECT count(*) AS n_golden, count(*) FILTER (WHERE ok) AS n_right, n_right / n_golden AS accuracy FROM m")
def e10(spark, d):
    return score.resolution_accuracy(*resolutions(spark, d))


@query("e11_non_merge_recall", RES + " SELECT count(*) AS n_golden, count(*) FILTER (WHERE same) AS n_found, n_found / n_golden AS recall FROM m WHERE want IN ('NEW', 'same_as_candidate')")
def e11(spark, d):
    return score.non_merge_recall(*resolutions(spark, d))


@query(
    "e8_resolution_calibration",
    RES + """, p AS (SELECT got IS NOT DISTINCT FROM want AS r, 0.5 + k % 50 / 100.0 AS confidence FROM g JOIN r USING (k))
    SELECT count(*) FILTER (WHERE r) AS n_right, count(*) FILTER (WHERE NOT r) AS n_wrong, round(greatest(0.0, least(1.0, avg(confidence) FILTER (WHERE r) - avg(confidence) FILTER (WHERE NOT r))), 9) AS margin FROM p""",
)
def e8_resolutions(spark, d):
    found, golden = resolutions(spark, d)
    found = found.withColumn("confidence", F.lit(0.5) + F.col("c_custkey") % 50 / 100.0)
    return score.resolution_calibration(found, golden).withColumn("margin", F.round("margin", 9))


@query("e12_score_stats", "SELECT event_type AS scorer, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def e12(spark, d):
    return score.score_stats(table(spark, d, "events").select(F.col("event_type").alias("scorer"), F.col("value").alias("score"))).withColumn("mean", F.round("mean", 6))


@query(
    "e13_rollup_issues",
    """WITH i AS (SELECT 'nation ' || c_nationkey AS kind, 'k' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS item FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'validation_error', 'e' || n_nationkey FROM nation WHERE n_nationkey < 2),
    g AS (SELECT kind, count(*) AS n, list_sort(list(item)) AS l FROM i GROUP BY kind)
    SELECT kind, n, array_to_string(CASE WHEN n <= 3 THEN l ELSE l[1:2] END, ', ') AS items, n > 3 AS collapsed, kind IN ('validation_error', 'contract_owner') AS signoff FROM g""",
)
def e13(spark, d):
    c = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("nation "), F.col("c_nationkey")).alias("kind"), F.concat(F.lit("k"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("item"))
    n = table(spark, d, "nation").where("n_nationkey < 2").select(F.lit("validation_error").alias("kind"), F.concat(F.lit("e"), F.col("n_nationkey")).alias("item"))
    return score.rollup_issues(c.unionByName(n))


@query("e14_usage_rollup", "SELECT event_type AS model, count(*) AS calls, CAST(sum(event_id) AS BIGINT) AS input_tokens, CAST(sum(user_id) AS BIGINT) AS output_tokens, CAST(sum(CASE WHEN event_id % 3 = 0 THEN event_id ELSE 0 END) AS BIGINT) AS cache_read_tokens, CAST(sum(CASE WHEN event_id % 5 = 0 THEN user_id ELSE 0 END) AS BIGINT) AS cache_write_tokens FROM events GROUP BY 1")
def e14(spark, d):
    path = shared_folder(spark)
    table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("event_id").alias("input_tokens"), F.col("user_id").alias("output_tokens"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("cache_read_tokens"), F.when(F.col("event_id") % 5 == 0, F.col("user_id")).alias("cache_write_tokens")).write.json(path)
    return score.usage_rollup(score.read_usage(spark, path))
