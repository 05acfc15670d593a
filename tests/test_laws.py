"""Golden bank vault, idempotence, and laws between loaders."""

import random

import pytest
from conftest import SF

from keelvault.functions.hashing import hash_key
from keelvault.operators import contract, extend, integrity, load, match, profile, read, score, stage
from keelvault.plans.spec import Hub, Link, Satellite, VaultSpec, load_bucketed_vault, load_vault, run_batches
from keelvault.queries import build
from keelvault.sources import feeds

DAY1, DAY2 = "2026-01-01 00:00:00", "2026-04-01 00:00:00"


def frame(spark, schema, rows, source):
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr(*[f"CAST({c} AS timestamp) AS {c}" if c in ("LOAD_DATETIME", "START_DATE") else c for c in df.columns]).selectExpr("*", f"'{source}' AS RECORD_SOURCE")


def bank(spark):
    customers = frame(spark, "CUSTOMER_ID string, NAME string, LOAD_DATETIME string", [(f"CH-100{i}", f"n{i}", DAY1) for i in (1, 2, 3)], "core")
    accounts = frame(spark, "ACCOUNT_ID string, BALANCE decimal(18,2), LOAD_DATETIME string", [(f"ACC-50{i}", None, DAY1) for i in range(4)], "core")
    pairs = [("ACC-500", "CH-1001"), ("ACC-501", "CH-1002"), ("ACC-502", "CH-1003"), ("ACC-503", "CH-1001")]
    rows = [(a, c, DAY1, DAY1) for a, c in pairs] + [("ACC-503", "CH-1002", DAY2, DAY2)]
    owners = frame(spark, "ACCOUNT_ID string, CUSTOMER_ID string, START_DATE string, LOAD_DATETIME string", rows, "core")
    keyed = {"CUSTOMER_HK": ["CUSTOMER_ID"], "ACCOUNT_HK": ["ACCOUNT_ID"]}
    return {
        "customer": stage.stage(customers, stage.StageSpec(keys={"CUSTOMER_HK": ["CUSTOMER_ID"]}, diffs={"HASHDIFF": ["NAME"]})),
        "account": stage.stage(accounts, stage.StageSpec(keys={"ACCOUNT_HK": ["ACCOUNT_ID"]}, diffs={"HASHDIFF": ["BALANCE"]})),
        "owner": stage.stage(owners, stage.StageSpec(keys=keyed | {"LINK_HK": ["ACCOUNT_ID", "CUSTOMER_ID"]})),
    }


SPEC = VaultSpec(
    hubs=[Hub("hub_customer", ["customer", "owner"], "CUSTOMER_HK", "CUSTOMER_ID"), Hub("hub_account", ["account"], "ACCOUNT_HK", "ACCOUNT_ID")],
    links=[Link("link_account_customer", "owner", "LINK_HK", ["ACCOUNT_HK", "CUSTOMER_HK"])],
    satellites=[
        Satellite("sat_customer", "customer", "CUSTOMER_HK", payload=["NAME"]),
        Satellite("sat_account", "account", "ACCOUNT_HK", payload=["BALANCE"]),
        Satellite("eff", "owner", "LINK_HK", kind="effectivity", driving=["ACCOUNT_ID"], secondary=["CUSTOMER_ID"]),
    ],
)


def test_bank_vault(spark):
    path = feeds.shared_folder(spark)
    stages = bank(spark)

    def counts(paths):
        return {r.table_name: r.n_rows for r in read.vault_counts({n: spark.read.parquet(p) for n, p in paths.items()}).collect()}

    first = stages | {"owner": stages["owner"].where(f"LOAD_DATETIME = '{DAY1}'")}
    paths = load_vault(spark, SPEC, first, path)
    expected = {"hub_customer": 3, "hub_account": 4, "link_account_customer": 4, "sat_customer": 3, "sat_account": 4, "eff": 4}
    assert counts(paths) == expected
    assert counts(load_vault(spark, SPEC, first, path)) == expected  # the same batch again
    second = stages | {"owner": stages["owner"].where(f"LOAD_DATETIME = '{DAY2}'")}
    assert counts(load_vault(spark, SPEC, second, path)) == expected | {"link_account_customer": 5, "eff": 6}
    assert counts(load_vault(spark, SPEC, second, path))["eff"] == 6
    current = load.current_effectivity(spark.read.parquet(paths["eff"]), "LINK_HK").where("ACCOUNT_ID = 'ACC-503'")
    found = {r[0]: (r[1], r[2]) for r in current.selectExpr("CUSTOMER_ID", "CAST(START_DATE AS string)", "CAST(END_DATE AS string)").collect()}
    assert found == {"CH-1001": (DAY1, DAY2), "CH-1002": (DAY2, "9999-12-31 00:00:00")}
    report = integrity.driving_key_exclusive(spark.read.parquet(paths["eff"]), "eff", "LINK_HK", ["ACCOUNT_ID"])
    assert [r.n_rows for r in report.collect()] == [0, 0]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_bucketed_vault(spark):
    """Bucketed tables hold what plain ones do, and a batch meets them without an exchange of theirs."""
    spark.sql("CREATE DATABASE IF NOT EXISTS bucketed")
    plain, stages = feeds.shared_folder(spark), bank(spark)
    for day in (DAY1, DAY1, DAY2):
        batch = stages | {"owner": stages["owner"].where(f"LOAD_DATETIME = '{day}'")}
        paths = load_vault(spark, SPEC, batch, plain)
        names = load_bucketed_vault(spark, SPEC, batch, "bucketed", 8)
    assert set(names) == set(paths)
    for part, name in names.items():
        one, other = spark.read.parquet(paths[part]), spark.table(name)
        assert one.count() == other.count() > 0 and one.exceptAll(other.select(*one.columns)).count() == 0
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for part, made in (
            ("hub_customer", lambda t: load.load_hub(stages["customer"], t, "CUSTOMER_HK", "CUSTOMER_ID")),
            ("sat_customer", lambda t: load.load_sat(stages["customer"], t, "CUSTOMER_HK", "HASHDIFF", ["NAME"])),
        ):
            assert exchanges(made(spark.table(names[part]))) == exchanges(made(spark.read.parquet(paths[part]))) - 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_keys_tell_separators_apart(spark):
    rows = [("A", "B||C"), ("A||B", "C"), ("A|", "|B"), ("A||", "B"), ("A", "||B"), ("^^", "x"), (None, "x"), ("\\^^", "x"), ("A\\", "B"), ("A\\|", "B")]
    keys = spark.createDataFrame(rows, "a string, b string").select(hash_key(["a", "b"]).alias("k"))
    assert keys.distinct().count() == len(rows)


def test_two_feeds_give_equal_hashes(spark):
    crm = spark.createDataFrame([("c001 ", DAY1), ("C002", DAY1), (None, DAY1), (" ", DAY1)], "cust_id string, LOAD_DATETIME string")
    victor = spark.createDataFrame([("C001", DAY2), ("C003", DAY2)], "partn_id string, LOAD_DATETIME string")
    made = [stage.canonical_key(df, "customer", c, ["cust_id", "partn_id"]).selectExpr("CUSTOMER_ID", "LOAD_DATETIME", f"'{c}' AS RECORD_SOURCE").withColumn("CUSTOMER_HK", hash_key(["CUSTOMER_ID"])) for df, c in ((crm, "cust_id"), (victor, "partn_id"))]
    hub = load.load_hub(made, None, "CUSTOMER_HK", "CUSTOMER_ID")
    assert sorted(r.CUSTOMER_ID.strip().upper() for r in hub.collect()) == ["C001", "C002", "C003"]
    assert load.load_hub(made, hub, "CUSTOMER_HK", "CUSTOMER_ID").count() == 0
    assert extend.preserved(hub, extend.add_feed(hub, made[1], "CUSTOMER_HK", "CUSTOMER_ID")).first().score == 1.0


def test_batches_equal_history(spark):
    """Effectivity loaded day by day is what the one-pass form gives."""
    days = build.daily_states(spark, SF).where("user_id < 4 AND LOAD_DATETIME < '2024-01-07'")
    args = ("EFF_HK", ["user_id"], ["event_type"])
    once = load.eff_sat_from_history(days, *args)
    stepped = run_batches(days, [f"2024-01-0{i}" for i in range(2, 7)], lambda b, t: load.load_eff_sat(b, t, *args))
    assert once.exceptAll(stepped.select(*once.columns)).count() == 0 and once.count() == stepped.count()


def random_history(seed, keys=5, partners=4, days=9, fixed=0.0):
    """Snapshots of driving keys with sets of partners that come, go and return. A relationship starts on
    the day it appears, or (a share of ``fixed``) on a day of its own, which may be long past."""
    rng = random.Random(seed)
    rows = []
    for a in [None, *(f"a{i}" for i in range(keys - 1))]:
        held, since = set(), {}
        for day in range(1, days + 1):
            if rng.random() < 0.2:
                continue  # no snapshot of this key
            now = {b for b in range(partners) if rng.random() < (0.8 if b in held else 0.25)}
            for b in now:
                if b not in held or b not in since:
                    since[b] = 1 if rng.random() < fixed else day
                rows.append((f"{a}-{b}", a, f"b{b}", f"2026-01-{since[b]:02} 00:00:00", f"2026-01-{day:02} 00:00:00"))
            held = now
    return rows


@pytest.mark.parametrize("seed,fixed", [(1, 0.0), (2, 0.0), (3, 0.5)])
def test_history_of_sets_equals_snapshots(spark, seed, fixed):
    """Several relationships of a driving key that end, return and leave gaps; null driving keys; starts
    that lie before what they would close."""
    history = frame(spark, "LINK_HK string, A string, B string, START_DATE string, LOAD_DATETIME string", random_history(seed, fixed=fixed), "s")
    args = ("LINK_HK", ["A"], ["B"])
    once = load.eff_sat_from_history(history.unionByName(history.limit(7)), *args)
    stepped = run_batches(history, [f"2026-01-{i:02}" for i in range(2, 10)], lambda b, t: load.load_eff_sat(b, t, *args)).select(*once.columns)
    assert once.exceptAll(stepped).count() == 0 and stepped.exceptAll(once).count() == 0
    assert once.count() > 20 and history.select("A", "LOAD_DATETIME").distinct().count() < history.count()


def test_lasting_relationships_make_no_records(spark):
    """Two relationships that last over two snapshots open once each; an ended one is closed by what follows."""
    rows = [("1", "a", "x", DAY1, DAY1), ("2", "a", "y", DAY1, DAY1), ("1", "a", "x", DAY1, DAY2), ("2", "a", "y", DAY1, DAY2)]
    got = load.eff_sat_from_history(frame(spark, "LINK_HK string, A string, B string, START_DATE string, LOAD_DATETIME string", rows, "s"), "LINK_HK", ["A"], ["B"])
    assert sorted(r.LINK_HK for r in got.select("LINK_HK").collect()) == ["1", "2"]


def test_reload_adds_nothing(spark):
    events = build.events_stage(spark, SF)
    sat = load.load_sat(events, None, "USER_HK", "HASHDIFF", ["event_type"])
    assert sat.count() > 0 and load.load_sat(events, sat, "USER_HK", "HASHDIFF", ["event_type"]).count() == 0
    split = run_batches(events, ["2024-01-05", "2024-01-15"], lambda b, t: load.load_sat(b, t, "USER_HK", "HASHDIFF", ["event_type"]))
    assert split.exceptAll(sat).count() == 0 and split.count() == sat.count()
    rows = build.multi_active(spark, SF)
    ma = load.load_ma_sat(rows, None, "ORDER_HK", ["l_linenumber", "l_partkey", "l_suppkey"], "HASHDIFF", ["QUANTITY"])
    assert load.load_ma_sat(rows, ma, "ORDER_HK", ["l_linenumber", "l_partkey", "l_suppkey"], "HASHDIFF", ["QUANTITY"]).count() == 0
    assert load.late_rows(events, sat, "USER_HK", "HASHDIFF").count() > 0


def test_rejected_effectivity(spark):
    columns = "LINK_HK string, A string, B string, START_DATE string, LOAD_DATETIME string"
    one = frame(spark, columns, [("1", "a", "x", DAY2, DAY2)], "s")
    target = load.load_eff_sat(one, None, "LINK_HK", ["A"], ["B"])
    early = frame(spark, columns, [("2", "a", "y", DAY1, "2026-05-01 00:00:00")], "s")
    assert load.load_eff_sat(early, target, "LINK_HK", ["A"], ["B"]).count() == 0
    assert load.rejected_effectivity(early, target, "LINK_HK", ["A"], ["B"]).count() == 1


def test_sound_successor_closes_beside_a_rejected_one(spark):
    columns = "LINK_HK string, A string, B string, START_DATE string, LOAD_DATETIME string"
    target = load.load_eff_sat(frame(spark, columns, [("1", "a", "x", DAY2, DAY2), ("9", None, "x", DAY1, DAY2)], "s"), None, "LINK_HK", ["A"], ["B"])
    later = "2026-05-01 00:00:00"
    batch = frame(spark, columns, [("2", "a", "y", DAY1, later), ("3", "a", "z", "2026-04-15 00:00:00", later), ("8", None, "y", later, later)], "s")
    got = {(r.LINK_HK, str(r.END_DATE)[:10]) for r in load.load_eff_sat(batch, target, "LINK_HK", ["A"], ["B"]).selectExpr("LINK_HK", "CAST(END_DATE AS string) AS END_DATE").collect()}
    assert got == {("3", "9999-12-31"), ("1", "2026-04-15"), ("8", "9999-12-31"), ("9", "2026-05-01")}
    assert [r.LINK_HK for r in load.rejected_effectivity(batch, target, "LINK_HK", ["A"], ["B"]).collect()] == ["2"]


def test_degenerate_key_tells_events_apart(spark):
    columns = "LINK_HK string, A string, B string, REF string, AT string, LOAD_DATETIME string"
    rows = frame(spark, columns, [("1", "a", "b", "t1", DAY1, DAY1), ("1", "a", "b", "t2", DAY1, DAY1), ("1", "a", "b", "t3", None, DAY1)], "s")
    args = ("LINK_HK", ["A", "B"], ["REF"], "AT")
    assert load.load_t_link(rows, None, *args).count() == 1
    once = load.load_t_link(rows, None, *args, degenerate_key=["REF"])
    assert once.count() == 2 and load.load_t_link(rows, once, *args, degenerate_key=["REF"]).count() == 0


def test_approximate_profile_is_near(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_returnflag")
    exact = {r.column_name: r.distinct_count for r in profile.profile_columns(df).collect()}
    for r in profile.profile_columns(df, approx=True).collect():
        assert abs(r.distinct_count - exact[r.column_name]) <= 0.1 * exact[r.column_name]


def test_contract_types(spark):
    df = spark.createDataFrame([("1", "2024-02-30", "2024-01-01"), ("x", "2024-01-01 10:00:00", None)], "n string, d string, e string")
    found = {r.column_name: r.n_rows for r in contract.check_types(df, {"n": ("integer",), "d": ("date",), "e": ("date", "null")}).collect()}
    assert found == {"n": 1, "d": 2, "e": 0}


def test_content_hash_ignores_order(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS k")
    assert extend.content_hash(df).first() == extend.content_hash(df.orderBy(df.id.desc())).first()
    assert extend.content_hash(df).first() != extend.content_hash(df.where("id > 0")).first()


def test_stream_loads_a_vault(spark, tmp_path):
    from keelvault.streaming.loads import stream_vault

    source = str(tmp_path / "in")
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    spec = VaultSpec(hubs=[Hub("hub_user", ["events"], "USER_HK", "user_id")])
    made = stage.StageSpec(keys={"USER_HK": ["user_id"]}, ldts="ts", source="events")
    stream_vault(stream, lambda b: {"events": stage.stage(b, made)}, spec, str(tmp_path / "vault"), str(tmp_path / "check")).awaitTermination(120)
    hub = spark.read.parquet(str(tmp_path / "vault" / "hub_user"))
    assert hub.count() == hub.select("user_id").distinct().count() == spark.read.parquet(source).select("user_id").distinct().count()


def test_content_hash_keeps_nulls_in_place(spark):
    rows = [[(None, "x")], [("x", None)], [("", "x")], [("^", "x")], [("a|=b", "c")], [("a", "b|=c")]]
    prints = {extend.content_hash(spark.createDataFrame(r, "a string, b string")).first().fingerprint for r in rows}
    assert len(prints) == len(rows)


def test_group_scores(spark):
    """Groups are matched by members; names only break ties, and ties without a name stay open."""

    def frames(found, golden):
        return [spark.createDataFrame([(n, m) for n, ms in g.items() for m in ms], "name string, member string") for g in (found, golden)]

    def matched(found, golden):
        return {(r.found_name, r.golden_name) for r in score.match_groups(*frames(found, golden)).collect()}

    assert matched({"link_b_a": ["hub a", "HUB_B"]}, {"link_a_b": ["hub_b", "hub_a"]}) == {("link_b_a", "link_a_b")}
    assert matched({"l": ["a", "a"]}, {"l": ["a"]}) == set()
    assert matched({"A": ["x", "y"], "B": ["x", "y"]}, {"b": ["y", "x"], "C": ["x", "y"]}) == {("B", "b")}
    matches = spark.createDataFrame([("f1", "g1")], "found_name string, golden_name string")
    keys = [spark.createDataFrame(r, "name string, element string") for r in ([("f1", "hub a")], [("g1", "HUB_A"), ("g2", "hub b")])]
    assert tuple(score.group_set_accuracy(matches, *keys).first()) == (2, 1, 0.5)


def test_mapping_scores(spark):
    golden = spark.createDataFrame([("amb", "t", "a"), ("amb", "t", "b"), ("city", "t", "c")], "concept string, table string, column string")
    gaps = spark.createDataFrame([("iban",)], "concept string")

    def proposed(*rows):
        return spark.createDataFrame([(*r, 0.9)[:4] if len(r) == 3 else r for r in rows], "concept string, table string, column string, confidence double")

    both = proposed(("amb", "T", "A"), ("amb", "t", "b"), ("city", "t", "c"))
    assert score.mapping_accuracy(both, golden, gaps).first().f1 == 1.0
    forced = proposed(("amb", "t", "a"), ("city", "t", "c"), ("iban", "t", "x"), ("other", "t", "y"))
    assert abs(score.mapping_accuracy(forced, golden, gaps).first().f1 - 2 * (2 / 3) * 1 / (2 / 3 + 1)) < 1e-12
    assert score.mapping_coverage(proposed(("z", "t", "a")), golden).first().coverage == 0.5
    assert tuple(score.gap_recall(gaps, proposed(("iban", "t", "x")), gaps).first()) == (1, 1, 1, 1.0)
    margin = score.calibration(proposed(("amb", "t", "a", 0.9), ("iban", "t", "x", 0.3)), golden, gaps).first()
    assert (margin.n_right, margin.n_wrong) == (1, 1) and abs(margin.margin - 0.6) < 1e-12
    empty = golden.limit(0)
    assert score.mapping_accuracy(proposed(("x", "t", "a")), empty).first().f1 == 1.0 and score.mapping_coverage(both, empty).first().coverage == 1.0
    # Equal labels of two entities are two concepts, where both sides have entities.
    own = spark.createDataFrame([("name", "person", "t", "a"), ("name", "firm", "t", "b")], "concept string, entity string, table string, column string")
    crossed = spark.createDataFrame([("name", "person", "t", "b", 0.5), ("name", "firm", "t", "b", 0.5)], "concept string, entity string, table string, column string, confidence double")
    assert score.mapping_accuracy(crossed, own).first().n_right == 1


def test_resolution_scores(spark):
    golden = spark.createDataFrame([("partner", "hub_customer", None), ("contact", "NEW", None), ("kunde", "same_as_candidate", "hub_customer")], "key string, resolution string, same_as string")

    def answers(*rows):
        return spark.createDataFrame([(*r, None)[:3] for r in rows], "key string, resolution string, same_as string")

    right = answers(("partner", "hub_customer"), ("contact", "NEW"), ("kunde", "same_as_candidate", "hub_customer"))
    assert score.false_merge_rate(right, golden).first().score == score.resolution_accuracy(right, golden).first().accuracy == 1.0
    assert score.false_merge_rate(answers(("kunde", "hub_customer")), golden).first().score == 0.0
    assert score.false_merge_rate(answers(("partner", "same_as_candidate", "x"), ("contact", "unresolved"), ("alien", "hub_z")), golden).first().score == 1.0
    assert score.resolution_accuracy(answers(("kunde", "same_as_candidate", "hub_account")), golden).first().n_right == 0
    assert score.resolution_accuracy(answers(("partner", "hub_customer"), ("partner", "NEW")), golden).first().n_right == 0
    assert score.non_merge_recall(answers(("contact", "NEW"), ("kunde", "same_as_candidate", "other")), golden).first().recall == 1.0
    assert score.non_merge_recall(answers(*((k, "unresolved") for k in ("partner", "contact", "kunde"))), golden).first().recall == 0.0


def test_token_matches_are_exact(spark):
    import random

    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + ("" if rng.random() < 0.7 else str(rng.randint(0, 4))) for _ in range(rng.randint(0, 9)))) for i in range(80)]
    df = spark.createDataFrame(texts, "id long, text string")
    sets = {i: {w.upper() for w in t.split()} for i, t in texts}
    for least in (1, 2, 4):
        got = {(r.a_id, r.b_id, r.n_shared) for r in match.match_tokens(df, df.where("id < 30"), "id", "text", "id", "text", least).collect()}
        assert got == {(i, j, len(sets[i] & sets[j])) for i in sets for j in range(30) if len(sets[i] & sets[j]) >= least}


def test_label_pairs(spark):
    a = spark.createDataFrame([(1, "x y"), (2, "X-Y"), (3, ""), (4, None), (5, "z")], "id long, label string")
    found = match.match_labels(a, a.where("id <> 2"), "id", "label", "id", "label")
    assert {(r.side, r.id, r.n_partners) for r in found.collect()} == {("a", 1, 1), ("a", 2, 1), ("b", 1, 2), ("a", 5, 1), ("b", 5, 1)}
    assert {(r.a_id, r.b_id) for r in match.label_pairs(found).collect()} == {(1, 1), (2, 1), (5, 5)}


def proposed(spark, hubs, fk=("Customer", ["PersonID"], "Person", ["BusinessEntityID"])):
    fks = spark.createDataFrame([("fk", *fk)], "fk string, table string, columns array<string>, ref_table string, ref_columns array<string>")
    keys = spark.createDataFrame([("Customer", "PersonID", "1"), ("Customer", "PersonID", "9"), ("Person", "BusinessEntityID", "1")], "source string, column string, value string")
    return match.propose_links(fks, spark.createDataFrame(hubs, "hub string, key string"), keys).first()


def test_links_are_proposed_by_key(spark):
    """The hub's key column is what counts; the referenced table only decides between several hubs."""
    got = proposed(spark, [("hub_person", "BUSINESSENTITYID")])
    assert (got.hub, got.outcome, got.containment) == ("hub_person", "renamed", 0.5)
    assert proposed(spark, [("hub_individual", "BusinessEntityID")]).hub == "hub_individual"
    assert proposed(spark, [("hub_person", "BusinessEntityID")], ("Customer", ["business-entity id"], "Person", ["BusinessEntityID"])).outcome == "renamed"
    assert proposed(spark, [("hub_person", "BUSINESS_ENTITY")], ("Customer", ["business entity"], "Person", ["Business-Entity"])).outcome == "same_name"
    assert proposed(spark, [("hub_person", "OTHER")]).outcome == "no_hub_for_key"
    two = [("hub_person", "BusinessEntityID"), ("hub_store", "BusinessEntityID")]
    assert proposed(spark, two).hub == "hub_person"
    assert proposed(spark, two, ("Customer", ["x"], "Vendor", ["BusinessEntityID"])).outcome == "ambiguous_hub"
    camel = [("hub_sales_order_header", "SalesOrderID"), ("hub_order", "SalesOrderID")]
    assert proposed(spark, camel, ("Detail", ["SalesOrderID"], "SalesOrderHeader", ["SalesOrderID"])).hub == "hub_sales_order_header"
    assert proposed(spark, camel, ("Detail", ["SalesOrderID"], "raw_order", ["SalesOrderID"])).hub == "hub_order"
    assert proposed(spark, two, ("Customer", ["a", "b"], "Person", ["c", "d"])).outcome == "composite_key"


def test_resolution_keys_are_normalised(spark):
    """Answers name keys as entity::column, perhaps with a gloss; golden keys are spelled in their own way."""
    golden = spark.createDataFrame([("CUST_ID", "hub_customer", None), ("partn_nr", "NEW", None)], "key string, resolution string, same_as string")

    def answers(*rows):
        return spark.createDataFrame([(*r, None, 0.9)[:4] if len(r) == 2 else (*r[:2], None, r[2]) for r in rows], "key string, resolution string, same_as string, confidence double")

    assert score.false_merge_rate(answers(("customer::cust id", "hub_account")), golden).first().score == 0.0
    assert score.false_merge_rate(answers(("cust-id", "hub_customer")), golden).first().n_merges == 1
    right = answers(("cust id", "hub_customer"), ("partner::partn_nr (national customer number)", "NEW"))
    assert score.resolution_accuracy(right, golden).first().accuracy == 1.0 and score.non_merge_recall(right, golden).first().recall == 1.0
    assert score.resolution_accuracy(answers(("crm_guid + partn_nr", "NEW")), golden).first().n_right == 0
    margin = score.resolution_calibration(answers(("a::cust_id", "hub_customer", 0.9), ("partn_nr", "hub_customer", 0.4), ("other", "NEW", 0.1)), golden).first()
    assert (margin.n_right, margin.n_wrong, round(margin.margin, 6)) == (1, 1, 0.5)
    assert score.resolution_calibration(answers(("partn_nr", "x", 0.4)), golden).first().margin == 0.0
    assert score.resolution_calibration(answers(("partn_nr", "NEW", 0.4)), golden).first().margin == 1.0


def test_usage_of_older_traces(spark):
    calls = spark.createDataFrame([("m", 3, None), (None, 1, 2)], "model string, input_tokens long, output_tokens long")
    got = {r.model: tuple(r)[1:] for r in score.usage_rollup(calls).collect()}
    assert got == {"m": (1, 3, 0, 0, 0), "unknown": (1, 1, 2, 0, 0)}


def test_fractions_are_no_integers(spark):
    df = spark.createDataFrame([(1.5, "7"), (None, "x")], "a double, b string")
    got = {r.column_name: r.n_rows for r in contract.check_types(df, {"a": ["integer"], "b": ["integer"]}).collect()}
    assert got == {"a": 1, "b": 1} and contract.check_types(df, {"a": ["number"]}).first().n_rows == 0


def test_several_hubs_with_all_values_are_unresolved(spark):
    keys = spark.createDataFrame([("s", "k", str(i)) for i in range(9)], "source string, column string, value string")
    hubs = spark.createDataFrame([(h, str(i)) for h in ("hub_x", "hub_y") for i in range(9)], "hub string, value string")
    got = match.resolve_entities(keys, hubs).first()
    assert (got.resolution, got.hub) == ("unresolved", None)
    assert match.resolve_entities(keys, hubs.where("hub = 'hub_x' OR value < '5'")).first().hub == "hub_x"


def test_kept_out_rows_are_told(spark):
    """A row with the target's load time and another hashdiff is not loaded, but late; events without a
    participation load nothing."""
    columns = "HK string, HASHDIFF string, V string, LOAD_DATETIME string"
    sat = load.load_sat(frame(spark, columns, [("1", "a", "x", DAY1)], "s"), None, "HK", "HASHDIFF", ["V"])
    batch = frame(spark, columns, [("1", "b", "y", DAY1), ("1", "a", "x", DAY1), ("2", "c", "z", DAY1)], "s")
    assert [r.HK for r in load.load_sat(batch, sat, "HK", "HASHDIFF", ["V"]).collect()] == ["2"]
    assert [r.HASHDIFF for r in load.late_rows(batch, sat, "HK", "HASHDIFF").collect()] == ["b"]
    events = frame(spark, "LINK_HK string, A string, B string, EFF string, LOAD_DATETIME string", [("1", "a", None, DAY1, DAY1), ("2", "a", "b", None, DAY1), ("3", "a", "b", DAY1, DAY1)], "s")
    assert [r.LINK_HK for r in load.load_t_link(events, None, "LINK_HK", ["A", "B"], [], "EFF").collect()] == ["3"]
    assert sorted((r.LINK_HK, r.reason) for r in load.rejected_events(events, ["A", "B"], "EFF").collect()) == [("1", "no_participation"), ("2", "no_event_time")]


def test_feeds_that_bring_a_key_together_are_both_its_origin(spark):
    """A key of both feeds at the same time is no other domain; one that a feed brought first is."""
    orders = frame(spark, "ORDER_HK string, CUSTOMER_HK string, LOAD_DATETIME string", [("o1", "c1", DAY1), ("o2", "c2", DAY2), ("o3", "c3", DAY1)], "orders")
    customers = frame(spark, "CUSTOMER_HK string, LOAD_DATETIME string", [("c1", DAY1), ("c2", DAY1), ("c3", DAY2)], "customer")
    first = feeds.union_feeds([df.select("CUSTOMER_HK", "LOAD_DATETIME", "RECORD_SOURCE") for df in (orders, customers)])
    found = extend.cross_domain_links(orders, {"ORDER_HK": (orders, "ORDER_HK"), "CUSTOMER_HK": (first, "CUSTOMER_HK")})
    assert [(r.ORDER_HK, r.ORDER_HK_ORIGIN, r.CUSTOMER_HK_ORIGIN) for r in found.collect()] == [("o2", "orders", "customer")]
