"""Vault integrity: checks on stored rows. Each gives (severity, code, construct, n_rows)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from keelvault.functions.hashing import is_blank, packed
from keelvault.operators.load import current_effectivity, high_date
from keelvault.operators.stage import LDTS, SOURCE, Staged


def issue(rows: DataFrame, severity: str, code: str, construct: str, count: Column | None = None) -> DataFrame:
    """One issue row with the number of rows (or ``count``)."""
    n = F.count("*") if count is None else F.coalesce(count, F.lit(0))
    return rows.agg(n.cast("long").alias("n_rows")).select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(construct).alias("construct"), "n_rows")


def issues(one: DataFrame, found: Sequence[tuple[str, str, str, Column]]) -> DataFrame:
    """Issue rows (severity, code, construct, number) from one row of numbers."""
    rows = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), F.lit(x).alias("construct"), F.coalesce(n, F.lit(0)).cast("long").alias("n_rows")) for s, c, x, n in found])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def narrow(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash keys in half their length where they only tell rows apart, so that less is exchanged."""
    return df.withColumns({c: packed(c) for c in keys if df.schema[c].dataType == StringType()})


def required_columns(table: DataFrame, construct: str, kind: str, pk: str, nk: str | None = None, hashdiff: str | None = None) -> DataFrame:
    """Nulls in required columns: hash key, load time, source, of hubs the business key, of satellites
    the hashdiff (effectivity satellites have none). A column that isn't there counts for all rows."""
    needed = [pk, LDTS, SOURCE, *([nk] if kind == "hub" and nk else []), *([hashdiff] if kind == "sat" and hashdiff else [])]
    present = [c for c in needed if c in table.columns]
    bad = reduce(lambda a, b: a | b, [is_blank(c) for c in present], F.lit(len(present) < len(needed)))
    code = "E_HUB_NO_BK" if kind == "hub" else "E_MISSING_COLUMN"
    return issue(table.where(bad), "error", code, construct)


def hub_unique(hub: DataFrame, construct: str, nk: str) -> DataFrame:
    return issue(hub.groupBy(nk).agg(F.count("*").alias("n")).where("n > 1"), "error", "E_DUP_HUB", construct, F.sum("n"))


def hash_collision(hub: DataFrame, construct: str, pk: str, nk: str) -> DataFrame:
    """Hashes that stand for several business keys."""
    return issue(hub.groupBy(pk).agg((F.min(nk) != F.max(nk)).alias("clash")).where("clash"), "error", "E_HUB_HK_COLLISION", construct)


def bk_collision(sat_a: DataFrame, sat_b: DataFrame, construct: str, pk: str, shared: Sequence[str]) -> DataFrame:
    """Keys of two feeds that disagree on shared attributes: perhaps different things."""
    a, b = sat_a.select(pk, *shared).alias("a"), sat_b.select(pk, *shared).alias("b")
    differ = reduce(lambda x, y: x | y, [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in shared])
    return issue(a.join(b, pk).where(differ).select(pk).distinct(), "warning", "W_BK_COLLISION_RISK", construct)


def link_orphans(link: DataFrame, construct: str, hubs: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Participations without a hub row, for each foreign key ({foreign key: (hub, hub key)})."""
    parts = [issue(narrow(link.select(fk), [fk]).join(narrow(hub.select(F.col(pk).alias(fk)), [fk]), fk, "left_anti"), "error", "E_LINK_UNKNOWN_HUB", f"{construct}.{fk}") for fk, (hub, pk) in hubs.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def link_arity(link: DataFrame, construct: str, fks: Sequence[str]) -> DataFrame:
    n = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in fks])
    return issue(link.where(n < 2), "error", "E_LINK_TOO_FEW_HUBS", construct)


def self_participation(link: DataFrame, construct: str, a: str, b: str) -> DataFrame:
    return issue(link.where(F.col(a).eqNullSafe(F.col(b))), "error", "E_LINK_DUP_ROLE", construct)


def redundant_grain(one: DataFrame, other: DataFrame, construct: str, fks: Sequence[str]) -> DataFrame:
    """Two links over the same hubs: the pairs that both have; ``share`` is that of all pairs."""
    a, b = one.select(*fks).distinct(), other.select(*fks).distinct()
    marked = a.withColumn("_kv_a", F.lit(1)).join(b.withColumn("_kv_b", F.lit(1)), list(fks), "full_outer")
    n = marked.agg(F.count_if(F.col("_kv_a").isNotNull() & F.col("_kv_b").isNotNull()).alias("n_rows"), F.count("*").alias("n"))
    return n.select(F.lit("warning").alias("severity"), F.lit("W_LINK_REDUNDANT_GRAIN").alias("code"), F.lit(construct).alias("construct"), "n_rows", F.coalesce(F.col("n_rows") / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("share"))


def txn_events(t_link: DataFrame, construct: str, pk: str, eff: str) -> DataFrame:
    """Events without a time, and rows of event keys that occur more than once."""
    keys = narrow(t_link.select(pk, eff), [pk]).groupBy(pk).agg(F.count("*").alias("n"), F.count_if(F.col(eff).isNull()).alias("none"))
    one = keys.agg(F.sum("none").alias("none"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("twice"))
    code = "E_TXNLINK_NO_TIMESTAMP"
    return issues(one, [("error", code, f"{construct}.{eff}", F.col("none")), ("error", code, f"{construct}.{pk}", F.col("twice"))])


def sat_orphans(sat: DataFrame, construct: str, pk: str, parent: DataFrame, parent_pk: str) -> DataFrame:
    return issue(narrow(sat.select(pk), [pk]).join(narrow(parent.select(F.col(parent_pk).alias(pk)), [pk]), pk, "left_anti"), "error", "E_SAT_UNKNOWN_PARENT", construct)


def empty_payload(sat: DataFrame, construct: str, payload: Sequence[str]) -> DataFrame:
    none = F.coalesce(*[F.col(c).cast("string") for c in payload]).isNull()
    return issue(sat.where(none), "error", "E_SAT_NO_PAYLOAD", construct)


def hub_without_sat(hub: DataFrame, construct: str, pk: str, sats: Sequence[DataFrame]) -> DataFrame:
    out = hub
    for s in sats:
        out = out.join(s.select(pk), pk, "left_anti")
    return issue(out, "warning", "W_HUB_NO_SAT", construct)


def plain_name(name: str) -> str:
    """A name in the form that ``normalize_identifier`` gives."""
    return re.sub("[^0-9a-zA-Z]+", "_", name).strip("_").upper()


def column_prints(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """A fingerprint of each column that depends on which row has which value: the sum of hashes of the
    row and the value. Equal columns of one type have equal fingerprints. One pass, whatever the number
    of columns; what comes to the driver is a number a column."""
    rows = df.select(F.xxhash64(*columns).alias("_kv_row"), *columns)
    sums = [F.sum(F.xxhash64("_kv_row", F.col(c), F.col(c).isNull()).cast("decimal(20,0)")).cast("string").alias(f"f{i}") for i, c in enumerate(columns)]
    one = rows.agg(*sums).first()
    return {c: one[i] for i, c in enumerate(columns)}


def duplicate_columns(sat: DataFrame, construct: str, payload: Sequence[str]) -> DataFrame:
    """Pairs of columns of one type that are equal in every row, or whose names are the same when normalised.

    Columns with equal fingerprints are compared with the first of them only, so the work is linear in
    the number of columns, and pairs are made of what is confirmed. Pairs with the same name are
    counted one by one."""
    types = dict(sat.dtypes)
    prints = column_prints(sat, payload)
    classes: dict[tuple, list[str]] = {}
    named: dict[tuple, list[str]] = {}
    for c in payload:
        classes.setdefault((types[c], prints[c]), []).append(c)
        named.setdefault((types[c], plain_name(c)), []).append(c)
    place = {c: i for i, c in enumerate(payload)}
    several = [c for c in classes.values() if len(c) > 1]
    same = [pair for c in named.values() for pair in combinations(c, 2)]
    first = {c: own[0] for own in several for c in own}
    one = sat.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).eqNullSafe(F.col(a))).alias(f"e{place[c]}") for c, a in first.items()], *[F.count_if(F.col(a).eqNullSafe(F.col(b))).alias(f"p{i}") for i, (a, b) in enumerate(same)])
    member = "struct<at:int,name:string,k:bigint>"
    groups = [F.array(*[F.struct(F.lit(place[c]).alias("at"), F.lit(c).alias("name"), F.col(f"e{place[c]}").alias("k")) for c in own]) for own in several]
    groups = one.select("n", F.explode(F.array(*groups) if groups else F.array().cast(f"array<array<{member}>>")).alias("c"))
    whole = groups.where("n > 0").select("n", F.filter("c", lambda x: x["k"] == F.col("n")).alias("c"))
    pairs = whole.select("n", F.explode("c").alias("a"), "c").select("n", "a", F.explode("c").alias("b")).where("a.at < b.at")
    equal = pairs.select(F.concat(F.lit(f"{construct}."), "a.name", F.lit("="), "b.name").alias("construct"), F.col("n").alias("n_rows"))
    told = [F.struct(F.lit(f"{construct}.{a}={b}").alias("construct"), F.col(f"p{i}").alias("n_rows")) for i, (a, b) in enumerate(same)]
    alike = one.select(F.explode(F.array(*told) if told else F.array().cast("array<struct<construct:string,n_rows:bigint>>")).alias("x")).select("x.*")
    out = equal.unionByName(alike).distinct()
    return out.select(F.lit("error").alias("severity"), F.lit("E_SAT_DUP_ATTR").alias("code"), "construct", "n_rows")


def attribute_overlap(one: DataFrame, other: DataFrame, construct: str, pk: str, attributes: Sequence[str], same_relation: bool, least: float = 0.95) -> DataFrame:
    """Attributes that two satellites of a parent historise with equal values in ``least`` of the keys."""
    a, b = one.select(pk, *attributes).alias("a"), other.select(pk, *attributes).alias("b")
    met = a.join(b, pk).agg(F.count("*").alias("n"), *[F.count_if(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(c) for c in attributes])
    rows = F.explode(F.array(*[F.struct(F.lit(f"{construct}.{c}").alias("construct"), F.col(c).alias("n_rows")) for c in attributes]))
    severity, code = ("error", "E_SAT_ATTR_OVERLAP") if same_relation else ("warning", "W_SAT_ATTR_OVERLAP_CROSS_SOURCE")
    out = met.select("n", rows.alias("x")).select("n", "x.*").where((F.col("n") > 0) & (F.col("n_rows") >= F.col("n") * least))
    return out.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), "construct", "n_rows")


def cdk_unique(sat: DataFrame | Staged, construct: str, pk: str, cdk: Sequence[str]) -> DataFrame:
    """Rows without a child key, and rows that share parent, child key and load time. A ``Staged`` is exchanged
    before its hash keys are made."""
    rows = sat.rows(pk) if isinstance(sat, Staged) else narrow(sat.select(pk, *cdk, LDTS), [pk])
    none = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cdk])
    one = rows.groupBy(pk, *cdk, LDTS).agg(F.count("*").alias("n")).agg(F.sum(F.when(none, F.col("n"))).alias("none"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("twice"))
    return issues(one, [("error", "E_MASAT_NO_CDK", f"{construct}.null", F.col("none")), ("error", "E_MASAT_NO_CDK", f"{construct}.duplicate", F.col("twice"))])


def parent_grain(stage: DataFrame, construct: str, pk: str) -> DataFrame:
    """Parents with several rows in one load: the relation is finer than its parent."""
    return issue(narrow(stage.select(pk, LDTS), [pk]).groupBy(pk, LDTS).agg(F.count("*").alias("n")).where("n > 1"), "warning", "W_MASAT_SHARED_GRAIN", construct)


def driving_key_exclusive(eff: DataFrame, construct: str, pk: str, dfk: Sequence[str]) -> DataFrame:
    """Driving keys with several open relationships, and periods that run into the next one's."""
    following = F.lead("START_DATE").over(Window.partitionBy(*dfk).orderBy("START_DATE", "END_DATE", pk))
    rows = current_effectivity(eff, pk).withColumn("_kv_next", following)
    keys = rows.groupBy(*dfk).agg(F.count_if(F.col("END_DATE") == high_date(eff)).alias("n"), F.count_if(F.col("_kv_next") < F.col("END_DATE")).alias("k"))
    one = keys.agg(F.count_if(F.col("n") > 1).alias("several"), F.sum("k").alias("overlap"))
    code = "E_EFFSAT_NO_DRIVING_KEY"
    return issues(one, [("error", code, f"{construct}.open", F.col("several")), ("error", code, f"{construct}.overlap", F.col("overlap"))])


def driving_key_in_link(eff: DataFrame, link: DataFrame, construct: str, pk: str, dfk: Sequence[str]) -> DataFrame:
    """Effectivity rows whose driving key is not among the participations of their link row: the link
    lacks the row or has other values; all rows where the link lacks such a column."""
    held = [c for c in dfk if c in link.columns]
    if len(held) < len(dfk):
        return issue(eff, "error", "E_DRIVING_KEY_NOT_IN_LINK", construct)
    own = link.select(F.col(pk).alias("_kv_pk"), *[F.col(c).alias(f"_kv_{c}") for c in dfk])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_kv_{c}")) for c in dfk], F.col(pk) == F.col("_kv_pk"))
    return issue(eff.join(own, same, "left_anti"), "error", "E_DRIVING_KEY_NOT_IN_LINK", construct)


def date_order(df: DataFrame, construct: str, start: str, end: str) -> DataFrame:
    """Rows without both dates, rows that end before they start, and rows of which a date can't be read."""
    s, e = F.col(start).try_cast("timestamp"), F.col(end).try_cast("timestamp")
    none = F.col(start).isNull() | F.col(end).isNull()
    unread = (F.col(start).isNotNull() & s.isNull()) | (F.col(end).isNotNull() & e.isNull())
    one = df.agg(F.count_if(none).alias("none"), F.count_if(e < s).alias("wrong"), F.count_if(unread).alias("unread"))
    return issues(one, [("error", "E_EFFSAT_DATES", construct, F.col("none")), ("error", "E_EFFSAT_DATE_ORDER", construct, F.col("wrong")), ("warning", "W_EFFSAT_DATE_ORDER_UNVERIFIED", construct, F.col("unread"))])


# Name parts that mark the start and the end of a period.
FROM_TOKENS = ("FROM", "START", "BEGIN", "VALID_FROM", "EFFECTIVE_FROM")
TO_TOKENS = ("TO", "END", "VALID_TO", "EFFECTIVE_TO")


def names_period_end(column: str, marks: Sequence[str]) -> bool:
    """Whether a part of the column's name is one of the marks; marks of two words stand anywhere in it."""
    name = re.sub("[^0-9a-zA-Z]+", "_", column).strip("_").upper()
    parts = name.split("_")
    return any(m in name if "_" in m else m in parts for m in marks)


def find_date_pairs(df: DataFrame, columns: Sequence[str], least: float = 0.99) -> DataFrame:
    """(start_column, end_column, ratio, named): ordered pairs of date columns with start <= end in at
    least ``least`` of the rows that have an end; pairs with telling names come first."""
    pairs = list(permutations(columns, 2))
    one = df.agg(*[F.avg(F.when(F.col(b).isNotNull(), (F.col(a) <= F.col(b)).cast("int"))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])

    def named(a: str, b: str) -> bool:
        return names_period_end(a, FROM_TOKENS) and names_period_end(b, TO_TOKENS)

    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("start_column"), F.lit(b).alias("end_column"), F.col(f"p{i}").alias("ratio"), F.lit(named(a, b)).alias("named")) for i, (a, b) in enumerate(pairs)]))
    return one.select(rows.alias("x")).select("x.*").where(F.col("ratio") >= least).orderBy(F.col("named").desc(), F.col("ratio").desc(), "start_column", "end_column")  # a row a pair of columns


def duplicate_feeds(one: DataFrame, other: DataFrame, construct: str, nk: str, least: float = 1.0) -> DataFrame:
    """Two feeds of a hub with the same key set: one source wired twice. One row, n_rows = shared keys,
    where their share of all keys is at least ``least``."""
    a, b = one.select(nk).distinct().withColumn("_kv_a", F.lit(1)), other.select(nk).distinct().withColumn("_kv_b", F.lit(1))
    met = a.join(b, nk, "full_outer").agg(F.count_if(F.col("_kv_a").isNotNull() & F.col("_kv_b").isNotNull()).alias("n_rows"), F.count("*").alias("n"))
    out = met.where((F.col("n") > 0) & (F.col("n_rows") >= F.col("n") * least))
    return out.select(F.lit("error").alias("severity"), F.lit("E_HUB_DUP_FEED").alias("code"), F.lit(construct).alias("construct"), "n_rows")


def feeds_integrate(one: DataFrame, other: DataFrame, construct: str, pk: str, nk: str) -> DataFrame:
    """Keys that two feeds share and hash differently."""
    a = one.select(nk, F.col(pk).alias("_kv_a")).distinct()
    b = other.select(nk, F.col(pk).alias("_kv_b")).distinct()
    return issue(a.join(b, nk).where("_kv_a <> _kv_b"), "error", "E_HUB_HK_COLLISION", construct)


def integrity_report(found: Sequence[DataFrame]) -> DataFrame:
    """Breaching rows by severity, code and construct, and whether the vault passes: no errors."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found).where("n_rows > 0")
    out = rows.groupBy("severity", "code", "construct").agg(F.sum("n_rows").alias("n_rows"))
    return out.withColumn("passed", ~F.max(F.col("severity") == "error").over(Window.partitionBy()))  # one row a breach kind
