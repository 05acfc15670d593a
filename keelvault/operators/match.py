"""Matching tables: by labels, tokens, key values and foreign keys. Equi-joins throughout."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelvault.functions.names import normalize_identifier, tokens
from keelvault.operators.profile import NULLS_ALLOWED, UNIQUE_ENOUGH
from keelvault.sources.feeds import written

# Tokens that say nothing about a column.
STOP_TOKENS = ("THE", "A", "AN", "OF", "ID", "NR", "NO", "DOC")


def match_labels(a: DataFrame, b: DataFrame, a_id: str, a_label: str, b_id: str, b_label: str) -> DataFrame:
    """(side, id, label, n_partners): every record of ``a`` and ``b`` that has partners, records of the other
    table with the same normalised label, and how many. Empty labels match nothing.

    Records meet through their label's class, so a frequent label makes as many rows as it has
    records, not pairs; ``label_pairs`` writes the pairs out."""
    both = [df.select(F.lit(side).alias("side"), F.col(i).alias("id"), normalize_identifier(c).alias("label")).where("label <> ''") for side, df, i, c in (("a", a, a_id, a_label), ("b", b, b_id, b_label))]
    rows = both[0].unionByName(both[1])
    classes = rows.groupBy(F.col("label").alias("_kv_label")).agg(F.count_if(F.col("side") == "a").alias("_kv_a"), F.count_if(F.col("side") == "b").alias("_kv_b")).where("_kv_a > 0 AND _kv_b > 0")
    return rows.join(classes, F.col("label") == F.col("_kv_label")).select("side", "id", "label", F.when(F.col("side") == "a", F.col("_kv_b")).otherwise(F.col("_kv_a")).alias("n_partners"))


def label_pairs(matches: DataFrame) -> DataFrame:
    """(a_id, b_id, label): the pairs of records of labels chosen from what ``match_labels`` gives."""
    one, other = (matches.where(F.col("side") == side).select(F.col("id").alias(f"{side}_id"), "label") for side in "ab")
    return one.join(other, "label").select("a_id", "b_id", "label")


def match_tokens(a: DataFrame, b: DataFrame, a_id: str, a_text: str, b_id: str, b_text: str, least: int = 1, stop: Sequence[str] = STOP_TOKENS, most_documents: int | None = None) -> DataFrame:
    """(a_id, b_id, n_shared): records that share at least ``least`` tokens. Ids are unique.

    A pair with ``least`` shared tokens shares one of the rarest tokens of both: all of a record's
    tokens that the other table has but the ``least`` - 1 most frequent. So records meet by their
    rare tokens only, and what they share is counted on their whole sets. With ``most_documents``
    tokens that more records of ``b`` have are left out as saying nothing (a frequency rule).

    Texts of ``a`` are split once, and those of their tokens that ``b`` has are written as hashes."""
    words = a.select(F.col(a_id).alias("id"), F.explode(F.array_distinct(F.split(a_text, "[^0-9a-zA-Z]+"))).alias("w"))
    left = words.select("id", F.upper("w").alias("token")).where((F.length("token") >= 2) & ~F.col("token").isin(*stop))  # as ``tokens``
    right = b.select(F.col(b_id).alias("id"), F.explode(tokens(b_text, 2, tuple(stop))).alias("token"))
    counts = right.groupBy("token").agg(F.count("*").alias("n"))
    if most_documents is not None:
        counts = counts.where(F.col("n") <= most_documents)
    held = written(left.join(counts, "token").select("id", F.xxhash64("token").alias("t"), "n"), "tokens")
    common = held.groupBy("t").agg((F.count("*") * F.max("n")).alias("n")).select(F.col("t").alias("_kv_t"), F.struct("n", "t").alias("x"))

    def ranked(df: DataFrame, name: str) -> DataFrame:
        sets = df.join(common, F.col("t") == F.col("_kv_t")).groupBy("id").agg(F.sort_array(F.collect_set("x")).alias("x"))  # a record's tokens
        return sets.where(F.size("x") >= least).select(F.col("id").alias(f"{name}_id"), F.transform("x", lambda x: x["t"]).alias(f"{name}_set"))

    def rare(df: DataFrame, name: str) -> DataFrame:
        of = F.col(f"{name}_set")
        return df.select("*", F.explode(F.slice(of, F.lit(1), F.size(of) - (least - 1))).alias("t"))

    one, other = ranked(held.select("id", "t"), "a"), ranked(right.select("id", F.xxhash64("token").alias("t")), "b")
    met = rare(one, "a").select("a_id", "t").join(rare(other, "b").select("b_id", "t"), "t").select("a_id", "b_id").distinct()
    full = met.join(other, "b_id").join(one, "a_id").select("a_id", "b_id", F.size(F.array_intersect("a_set", "b_set")).cast("long").alias("n_shared"))
    return full.where(F.col("n_shared") >= least)


def tier(candidates: DataFrame, profile: DataFrame) -> DataFrame:
    """``candidates`` (concept, column_name, comment, kind, ...) with ``tier``: exact_name,
    comment_grounded, profiled_key or other, by ``profile`` (column_name, uniqueness_ratio, null_ratio)."""
    p = profile.select(F.col("column_name").alias("_kv_column"), "uniqueness_ratio", "null_ratio")
    out = candidates.join(p, F.col("column_name") == F.col("_kv_column"), "left")
    exact = normalize_identifier("concept") == normalize_identifier("column_name")
    grounded = F.arrays_overlap(tokens("concept", 2, STOP_TOKENS), tokens(F.coalesce("comment", F.lit("")), 2, STOP_TOKENS))
    profiled = (F.col("kind") == "business_key") & (F.col("uniqueness_ratio") >= UNIQUE_ENOUGH) & (F.col("null_ratio") <= NULLS_ALLOWED)
    chosen = F.when(exact, "exact_name").when(grounded, "comment_grounded").when(profiled, "profiled_key").otherwise("other")
    return out.select(*[F.col(f"`{c}`") for c in candidates.columns], chosen.alias("tier"))


def triage(items: DataFrame, candidates: DataFrame, targets: DataFrame, item: str | Sequence[str] = "item", target: str = "target") -> DataFrame:
    """(item, outcome, target): mapped with one candidate, gap with none, unresolved with several or
    with one that is not among ``targets`` (nothing is invented). What identifies an item may be
    several columns, such as a concept's label and its entity; nulls in them are equal."""
    keys = [item] if isinstance(item, str) else list(item)
    known = candidates.join(targets.select(F.col(target).alias("_kv_target")).distinct(), F.col(target) == F.col("_kv_target"), "left")
    by_item = known.groupBy(*[F.col(k).alias(f"_kv_i_{k}") for k in keys]).agg(F.count_distinct(target).alias("n"), F.min(target).alias("_kv_only"), F.count("_kv_target").alias("_kv_known"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_kv_i_{k}")) for k in keys])
    out = items.select(*keys).distinct().join(by_item, same, "left")
    outcome = F.when(F.col("n").isNull() | (F.col("n") == 0), "gap").when((F.col("n") == 1) & (F.col("_kv_known") > 0), "mapped").otherwise("unresolved")
    return out.select(*keys, outcome.alias("outcome"), F.when(outcome == "mapped", F.col("_kv_only")).alias(target))


def containment(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """(n_values, n_found, containment): distinct non-null child values, and those the parent has."""
    values = child.select(F.col(column).cast("string").alias("v")).where("v IS NOT NULL").distinct()
    found = parent.select(F.col(key).cast("string").alias("v")).distinct().withColumn("_kv_found", F.lit(1))
    one = values.join(found, "v", "left").agg(F.count("*").alias("n_values"), F.count("_kv_found").alias("n_found"))
    return one.withColumn("containment", F.coalesce(F.col("n_found") / F.nullif("n_values", F.lit(0)), F.lit(0.0)))


def column_containment(keys_long: DataFrame) -> DataFrame:
    """(child_source, child_column, parent_source, parent_column, n_shared, n_child): for all pairs of
    columns of ``keys_long`` (source, column, value) that share a value.

    Columns are collected by value (a value is in as many columns as there are, not in rows), so a
    common value makes pairs of columns, never of rows."""
    values = keys_long.where("value IS NOT NULL").select("source", "column", "value").distinct()
    sets = values.groupBy("value").agg(F.collect_set(F.struct("source", "column")).alias("c"))
    pairs = sets.select("c", F.explode("c").alias("a")).select("a", F.explode("c").alias("b")).where("a <> b")
    shared = pairs.groupBy("a", "b").agg(F.count("*").alias("n_shared"))
    sizes = values.groupBy("source", "column").agg(F.count("*").alias("n_child"))
    out = shared.select(F.col("a.source").alias("child_source"), F.col("a.column").alias("child_column"), F.col("b.source").alias("parent_source"), F.col("b.column").alias("parent_column"), "n_shared")
    return out.join(sizes.select(F.col("source").alias("child_source"), F.col("column").alias("child_column"), "n_child"), ["child_source", "child_column"])


#: Values of a column that are looked up first, those with the smallest hashes, and slices that find them.
LOOKED_UP, SLICES = 64, 16


def propose_containment(keys_long: DataFrame, least: float = 0.9, looked_up: int = LOOKED_UP) -> DataFrame:
    """(child_source, child_column, parent_source, parent_column): pairs of columns of which the parent
    probably holds ``least`` of the child's values.

    Of each column the ``looked_up`` values with the smallest hashes are an even sample; they are looked
    up among the values of all columns, so a value that all columns share makes pairs for at most so many
    values of a column. A pair is proposed if its share of the sample is at most four standard deviations
    below ``least``; columns of fewer values are looked up as a whole."""
    values = keys_long.where("value IS NOT NULL").select("source", "column", "value").distinct()
    hashed = values.withColumn("h", F.xxhash64("value", F.lit(6)))
    # Slices of a column keep their own first values, so that no task orders a whole column.
    own = Window.partitionBy("source", "column", F.pmod("h", F.lit(SLICES))).orderBy("h", "value")
    few = hashed.withColumn("k", F.row_number().over(own)).where(F.col("k") <= looked_up)
    sample = few.withColumn("k", F.row_number().over(Window.partitionBy("source", "column").orderBy("h", "value"))).where(F.col("k") <= looked_up)
    child = sample.select(F.col("source").alias("child_source"), F.col("column").alias("child_column"), "value")
    sizes = child.groupBy("child_source", "child_column").agg(F.count("*").alias("n"))
    parent = values.select(F.col("source").alias("parent_source"), F.col("column").alias("parent_column"), "value")
    other = (F.col("child_source") != F.col("parent_source")) | (F.col("child_column") != F.col("parent_column"))
    pair = ["child_source", "child_column", "parent_source", "parent_column"]
    found = child.join(parent, "value").where(other).groupBy(*pair).agg(F.count("*").alias("k"))
    lowest = F.col("n") * least - 4 * F.sqrt(F.col("n") * F.lit(least * (1 - least)))
    return found.join(sizes, ["child_source", "child_column"]).where(F.col("k") >= lowest).select(*pair)


def contained_columns(keys_long: DataFrame, least: float = 0.9, looked_up: int = LOOKED_UP) -> DataFrame:
    """(child_source, child_column, parent_source, parent_column, n_shared, n_child, containment): pairs of
    columns of which the parent holds ``least`` of the child's distinct values, counted exactly for the
    proposed pairs. A pair at the limit is missed with a chance below 1e-4 by the sample; columns of
    at most ``looked_up`` values never."""
    out = shared_values(keys_long, written(propose_containment(keys_long, least, looked_up), "proposed"))
    return out.where(F.col("containment") >= least)


def shared_values(keys_long: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` of columns (child_source, child_column, parent_source, parent_column) that share a value,
    with n_shared and n_child, distinct values of both and of the child, and their ratio containment."""
    pairs = pairs.select("child_source", "child_column", "parent_source", "parent_column").distinct()
    values = written(keys_long.where("value IS NOT NULL").select("source", "column", "value").distinct(), "values")
    child = values.select(F.col("source").alias("child_source"), F.col("column").alias("child_column"), "value")
    parent = values.select(F.col("source").alias("parent_source"), F.col("column").alias("parent_column"), "value")
    sizes = child.groupBy("child_source", "child_column").agg(F.count("*").alias("n_child"))
    both = child.join(pairs, ["child_source", "child_column"]).join(parent, ["parent_source", "parent_column", "value"])
    shared = both.groupBy("child_source", "child_column", "parent_source", "parent_column").agg(F.count("*").alias("n_shared"))
    out = shared.join(sizes, ["child_source", "child_column"]).withColumn("containment", F.col("n_shared") / F.col("n_child"))
    return out.select("child_source", "child_column", "parent_source", "parent_column", "n_shared", "n_child", "containment")


def anchor_column(keys_long: DataFrame) -> DataFrame:
    """(source, column): the one column that has the values of all the others; none if several do or none does."""
    values = keys_long.where("value IS NOT NULL").select("source", "column", "value").distinct()
    columns = values.select("source", "column").distinct()
    n = columns.agg(F.count("*").alias("n"))
    full = contained_columns(keys_long, 1.0).groupBy(F.col("parent_source").alias("source"), F.col("parent_column").alias("column")).agg(F.count("*").alias("k"))
    anchors = full.crossJoin(F.broadcast(n)).where("k = n - 1").select("source", "column")  # n is a single row
    alone = anchors.agg(F.count("*").alias("m"), F.first("source").alias("source"), F.first("column").alias("column"))
    return alone.where("m = 1").select("source", "column")


# Prefixes of a construct's kind, and that of a raw source table.
KIND_PREFIX, RAW_PREFIX = "^(hub_|link_|sat_)", "RAW"


def _joined_name(c) -> Column:
    """A name without separators: SalesOrder, sales_order and SALES-ORDER are one."""
    return F.replace(normalize_identifier(c), F.lit("_"), F.lit(""))


def names_table(hub: str, table: str) -> Column:
    """Whether a hub, without its prefix, has the name of a source table, or of its raw form."""
    base, name = _joined_name(F.regexp_replace(hub, KIND_PREFIX, "")), _joined_name(table)
    return (name == base) | (name == F.concat(F.lit(RAW_PREFIX), base))


def propose_links(fks: DataFrame, hubs: DataFrame, keys_long: DataFrame) -> DataFrame:
    """One outcome for each foreign key (fk, table, columns, ref_table, ref_columns): the hub that it
    meets, same_name or renamed, with the containment of its values, or the reason why not:
    composite_key, no_hub_for_key, ambiguous_hub.

    A hub (hubs: hub, key) is met by its canonical key column. The referenced table only decides
    between several hubs with this key, by the hub's name. ``keys_long`` holds the values (source =
    table, column, value) of keys and foreign keys."""
    single = fks.withColumns({"col": F.get("columns", F.lit(0)), "ref": F.get("ref_columns", F.lit(0)), "composite": F.size("columns") != 1})
    h = hubs.select("hub", F.col("key").alias("_kv_key"), normalize_identifier("key").alias("_kv_k")).distinct()
    met = single.join(h, normalize_identifier("ref") == F.col("_kv_k"), "left").withColumn("_kv_named", F.coalesce(names_table("hub", "ref_table"), F.lit(False)))
    one = F.struct("hub", "_kv_key")
    met = met.groupBy("fk", "table", "col", "ref_table", "ref", "composite").agg(F.count_distinct("hub").alias("n"), F.min(one).alias("only"), F.count_distinct(F.when(F.col("_kv_named"), F.col("hub"))).alias("m"), F.min(F.when(F.col("_kv_named"), one)).alias("named"))
    chosen = F.when(F.col("n") == 1, F.col("only")).when(F.col("m") == 1, F.col("named"))
    met = met.withColumn("chosen", chosen)
    reason = F.when(F.col("composite"), "composite_key").when(F.col("n") == 0, "no_hub_for_key").when(F.col("chosen").isNull(), "ambiguous_hub")
    kind = F.when(normalize_identifier("col") == normalize_identifier("chosen._kv_key"), "same_name").otherwise("renamed")
    declared = single.select(F.col("table").alias("child_source"), F.col("col").alias("child_column"), F.col("ref_table").alias("parent_source"), F.col("ref").alias("parent_column"))
    held = shared_values(keys_long, declared).select(F.col("child_source").alias("table"), F.col("child_column").alias("col"), F.col("parent_source").alias("ref_table"), F.col("parent_column").alias("ref"), F.col("containment").alias("share"))
    out = met.join(held, ["table", "col", "ref_table", "ref"], "left")
    good = reason.isNull()
    return out.select("fk", F.when(good, F.col("chosen.hub")).alias("hub"), F.when(good, kind).otherwise(reason).alias("outcome"), F.when(good, F.coalesce("share", F.lit(0.0))).alias("containment"))


def key_value_overlap(new: DataFrame, column: str, hub: DataFrame, key: str) -> DataFrame:
    """(n_new, n_hub, n_both, jaccard, new_in_hub, hub_in_new) over distinct non-null values."""
    a = new.select(F.col(column).cast("string").alias("v")).where("v IS NOT NULL").distinct().withColumn("a", F.lit(1))
    b = hub.select(F.col(key).cast("string").alias("v")).where("v IS NOT NULL").distinct().withColumn("b", F.lit(1))
    one = a.join(b, "v", "full_outer").agg(F.count("a").alias("n_new"), F.count("b").alias("n_hub"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"))

    def ratio(n):
        return F.coalesce(F.col("n_both") / F.nullif(n, F.lit(0)), F.lit(0.0))

    return one.select("*", ratio(F.col("n_new") + F.col("n_hub") - F.col("n_both")).alias("jaccard"), ratio(F.col("n_new")).alias("new_in_hub"), ratio(F.col("n_hub")).alias("hub_in_new"))


def resolve_entities(keys_long: DataFrame, hub_keys: DataFrame, comments: DataFrame | None = None, enough: float = 0.95, some: float = 0.05) -> DataFrame:
    """(source, column, resolution, hub, overlap) for each new key column of ``keys_long`` (source,
    column, value) against ``hub_keys`` (hub, value).

    exact_key when at least ``enough`` of its values are keys of one hub, more than of any other;
    unresolved when several hubs have as many; key_overlap when another column of its source is an
    exact key (a cross-reference: asserted equal, never merged); comment_grounded when its comment
    (source, column, comment) names a hub; NEW when at most ``some`` of its values are known; else
    unresolved."""
    values = keys_long.where("value IS NOT NULL").select("source", "column", F.col("value").cast("string").alias("value")).distinct()
    sizes = values.groupBy("source", "column").agg(F.count("*").alias("n"))
    met = values.join(hub_keys.select("hub", F.col("value").cast("string").alias("value")).distinct(), "value").groupBy("source", "column", "hub").agg(F.count("*").alias("k"))
    best = met.groupBy("source", "column", "k").agg(F.count("*").alias("hubs"), F.min("hub").alias("hub")).groupBy("source", "column").agg(F.max(F.struct("k", "hubs", "hub")).alias("x"))
    shares = sizes.join(best, ["source", "column"], "left").select("source", "column", F.coalesce(F.col("x.k") / F.col("n"), F.lit(0.0)).alias("overlap"), F.col("x.hub").alias("hub"), (F.coalesce("x.hubs", F.lit(0)) > 1).alias("tied"))
    exact = shares.where((F.col("overlap") >= enough) & ~F.col("tied")).groupBy("source").agg(F.min(F.struct("column", "hub")).alias("e"))
    out = shares.join(exact, "source", "left")
    if comments is not None:
        words = comments.select("source", "column", F.explode(tokens("comment", 2, STOP_TOKENS)).alias("w"))
        hubs = hub_keys.select("hub").distinct().select("hub", F.explode(tokens("hub", 2, (*STOP_TOKENS, "HUB"))).alias("w"))
        named = words.join(hubs, "w").groupBy("source", "column").agg(F.min("hub").alias("said"))
        out = out.join(named, ["source", "column"], "left")
    else:
        out = out.withColumn("said", F.lit(None).cast("string"))
    kind = (
        F.when(F.col("overlap") >= enough, F.when(F.col("tied"), "unresolved").otherwise("exact_key"))
        .when(F.col("e").isNotNull() & (F.col("e.column") != F.col("column")), "key_overlap")
        .when(F.col("said").isNotNull(), "comment_grounded")
        .when(F.col("overlap") <= some, "NEW")
        .otherwise("unresolved")
    )
    hub = F.when(kind == "exact_key", F.col("hub")).when(kind == "key_overlap", F.col("e.hub")).when(kind == "comment_grounded", F.col("said"))
    return out.select("source", "column", kind.alias("resolution"), hub.alias("hub"), "overlap")


def same_as_candidates(xref: DataFrame, a_key: str, b_key: str, hub_a: DataFrame, a_nk: str, hub_b: DataFrame, b_nk: str) -> DataFrame:
    """(a, b): pairs that a cross-reference asserts equal and both hubs hold; a flag, never a merge."""
    out = xref.select(F.col(a_key).alias("a"), F.col(b_key).alias("b")).distinct()
    return out.join(hub_a.select(F.col(a_nk).alias("a")), "a", "left_semi").join(hub_b.select(F.col(b_nk).alias("b")), "b", "left_semi")


def dedupe_first(records: DataFrame, key: str, order: str) -> DataFrame:
    """The first record of each normalised key by ``order``, with ``n_dropped``, the others of its key."""
    others = [c for c in records.columns if c != order]
    rows = records.withColumn("_kv_key", normalize_identifier(key)).groupBy("_kv_key").agg(F.min(F.struct(order, *others)).alias("x"), (F.count("*") - 1).alias("n_dropped"))
    return rows.select(*[F.col(f"x.{c}").alias(c) for c in records.columns], "n_dropped")


def overlay_decisions(proposals: DataFrame, decisions: DataFrame, key: str, reference: str, value: str) -> DataFrame:
    """Proposals (key, reference, value) under a reviewer's decisions (reference, value): a decision
    overrides; a reference that fits several proposals is ignored; what isn't mentioned is accepted.
    Of several decisions on a reference the smallest value counts."""
    once = decisions.groupBy(reference).agg(F.min(value).alias("_kv_value"), F.lit(True).alias("_kv_decided"))
    n = proposals.groupBy(reference).agg(F.count("*").alias("_kv_n"))
    out = proposals.join(n, reference, "left").join(once, reference, "left")
    used = F.coalesce(F.col("_kv_decided"), F.lit(False)) & (F.col("_kv_n") == 1)
    status = F.when(used, "overridden").when(F.coalesce(F.col("_kv_decided"), F.lit(False)), "ambiguous").otherwise("accepted")
    return out.select(key, reference, F.when(used, F.col("_kv_value")).otherwise(F.col(value)).alias(value), status.alias("status"))
