"""Scoring match proposals against golden tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelvault.functions.names import normalize_identifier


def _ratio(a: Column, b: Column, empty: float) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(empty))


def _f1(both: Column, found: Column, golden: Column) -> Column:
    """1 when both sides are empty, else the harmonic mean of precision and recall."""
    return F.when((found == 0) & (golden == 0), 1.0).otherwise(_ratio(2.0 * both, found + golden, 0.0))


def set_f1(found: DataFrame, golden: DataFrame, keys: Sequence[str], kind: str = "kind") -> DataFrame:
    """(kind, n_found, n_golden, n_both, precision, recall, f1) for each kind that golden has."""
    a = found.select(kind, *keys).distinct().withColumn("_kv_a", F.lit(1))
    b = golden.select(kind, *keys).distinct().withColumn("_kv_b", F.lit(1))
    met = a.join(b, [kind, *keys], "full_outer").groupBy(kind).agg(F.count("_kv_a").alias("n_found"), F.count("_kv_b").alias("n_golden"), F.count_if(F.col("_kv_a").isNotNull() & F.col("_kv_b").isNotNull()).alias("n_both"))
    met = met.where("n_golden > 0")
    return met.select("*", _ratio(F.col("n_both"), F.col("n_found"), 0.0).alias("precision"), (F.col("n_both") / F.col("n_golden")).alias("recall"), _f1(F.col("n_both"), F.col("n_found"), F.col("n_golden")).alias("f1"))


def mean_f1(scores: DataFrame) -> DataFrame:
    """(mean_f1, n_kinds) over the kinds that golden has."""
    return scores.agg(F.avg("f1").alias("mean_f1"), F.count("*").alias("n_kinds"))


def match_groups(found: DataFrame, golden: DataFrame, name: str = "name", member: str = "member") -> DataFrame:
    """(found_name, golden_name): golden groups with the found group of the same multiset of members.

    Names count only where several found groups have these members: then the one with the same
    normalised name is meant, and without such a one the golden group stays unmatched."""

    def sets(df: DataFrame, as_name: str) -> DataFrame:
        return df.groupBy(F.col(name).alias(as_name)).agg(F.md5(F.array_join(F.sort_array(F.collect_list(normalize_identifier(member))), ",").cast("binary")).alias("_kv_set"))

    a, b = sets(found, "found_name"), sets(golden, "golden_name")
    by_set = a.groupBy("_kv_set").agg(F.count("*").alias("_kv_n"), F.min("found_name").alias("_kv_only"))
    by_name = a.groupBy("_kv_set", normalize_identifier("found_name").alias("_kv_name")).agg(F.min("found_name").alias("_kv_named"))
    met = b.join(by_set, "_kv_set").withColumn("_kv_name", normalize_identifier("golden_name")).join(by_name, ["_kv_set", "_kv_name"], "left")
    chosen = F.when(F.col("_kv_n") == 1, F.col("_kv_only")).otherwise(F.col("_kv_named"))
    return met.select(chosen.alias("found_name"), "golden_name").where("found_name IS NOT NULL")


def group_set_accuracy(matches: DataFrame, found: DataFrame, golden: DataFrame, name: str = "name", element: str = "element") -> DataFrame:
    """(n_groups, n_right, accuracy): golden groups that declare a subset, such as a driving key, and
    those whose matched group declares the same; one without a counterpart is a miss; 1.0 without groups."""

    def sets(df: DataFrame, as_name: str, as_set: str) -> DataFrame:
        return df.groupBy(F.col(name).alias(as_name)).agg(F.sort_array(F.collect_set(normalize_identifier(element))).alias(as_set))

    met = sets(golden, "golden_name", "g").join(matches, "golden_name", "left").join(sets(found, "found_name", "f"), "found_name", "left")
    one = met.agg(F.count("*").alias("n_groups"), F.count_if(F.col("f") == F.col("g")).alias("n_right"))
    return one.withColumn("accuracy", _ratio(F.col("n_right"), F.col("n_groups"), 1.0))


def _named(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with these columns normalised, and ``entity``: a concept is a label of an entity, or of
    none in frames without that column."""
    entity = F.coalesce(normalize_identifier("entity"), F.lit("")) if "entity" in df.columns else F.lit("")
    return df.withColumns({c: normalize_identifier(c) for c in columns} | {"entity": entity})


CONCEPT, PAIR = ["concept", "entity"], ["table", "column"]


def _scored(proposals: DataFrame, golden: DataFrame, gaps: DataFrame | None) -> DataFrame:
    """Proposals on the concepts that ``golden`` or ``gaps`` judge, and whether they are right: a concept
    may have several golden columns, each of them right; a gap has none."""
    g = _named(golden, "concept", *PAIR).select(*CONCEPT, *PAIR).distinct()
    judged = g.select(*CONCEPT)
    if gaps is not None:
        judged = judged.unionByName(_named(gaps, "concept").select(*CONCEPT))
    p = _named(proposals, "concept", *PAIR).join(judged.distinct(), CONCEPT, "left_semi")
    return p.join(g.withColumn("_kv_g", F.lit(1)), [*CONCEPT, *PAIR], "left").withColumn("right", F.col("_kv_g").isNotNull()).drop("_kv_g")


def mapping_accuracy(proposals: DataFrame, golden: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """(n_proposed, n_golden, n_right, n_concepts, f1) over the concepts of ``golden`` and ``gaps``.

    Precision is the share of right proposals (n_right of n_proposed), recall that of golden concepts
    with a right proposal (n_concepts of n_golden). Proposals on gaps are wrong, those on other
    concepts don't count. 1.0 with nothing to judge."""
    p = _scored(proposals, golden, gaps)
    one = p.agg(F.count("*").alias("n_proposed"), F.count_if("right").alias("n_right"), F.count_distinct(F.when(F.col("right"), F.struct(*CONCEPT))).alias("n_concepts"))
    n = _named(golden, "concept").agg(F.count_distinct(F.struct(*CONCEPT)).alias("n_golden"))
    precision, recall = _ratio(F.col("n_right"), F.col("n_proposed"), 0.0), _ratio(F.col("n_concepts"), F.col("n_golden"), 0.0)
    f1 = F.when((F.col("n_golden") == 0) & (F.col("n_proposed") == 0), 1.0).otherwise(_ratio(2 * precision * recall, precision + recall, 0.0))
    return one.crossJoin(n).select("n_proposed", "n_golden", "n_right", "n_concepts", f1.alias("f1"))  # two single rows


def gap_recall(gaps: DataFrame, proposals: DataFrame, golden_gaps: DataFrame) -> DataFrame:
    """(n_golden, n_found, n_forced, recall): concepts without a source that were named as gaps, and
    those that a proposal binds, whether named or not."""
    g = _named(golden_gaps, "concept").select(*CONCEPT).distinct()
    named = _named(gaps, "concept").select(*CONCEPT).distinct().withColumn("_kv_n", F.lit(1))
    bound = _named(proposals, "concept").select(*CONCEPT).distinct().withColumn("_kv_b", F.lit(1))
    met = g.join(named, CONCEPT, "left").join(bound, CONCEPT, "left")
    one = met.agg(F.count("*").alias("n_golden"), F.count("_kv_n").alias("n_found"), F.count("_kv_b").alias("n_forced"))
    return one.withColumn("recall", _ratio(F.col("n_found"), F.col("n_golden"), 1.0))


def mapping_coverage(proposals: DataFrame, golden: DataFrame) -> DataFrame:
    """(n_golden, n_found, coverage): golden concepts of which some proposal, on whatever concept,
    binds one of the listed (table, column) pairs."""
    g = _named(golden, "concept", *PAIR).select(*CONCEPT, *PAIR).distinct()
    p = _named(proposals, *PAIR).select(*PAIR).distinct().withColumn("_kv_p", F.lit(1))
    met = g.join(p, PAIR, "left").groupBy(*CONCEPT).agg(F.max("_kv_p").alias("_kv_p"))
    return met.agg(F.count("*").alias("n_golden"), F.count("_kv_p").alias("n_found")).withColumn("coverage", _ratio(F.col("n_found"), F.col("n_golden"), 1.0))


def false_friend_hits(proposals: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(n_hits, score): proposals on forbidden columns; 1.0 without any, else 0.0."""
    pair = [normalize_identifier("table").alias("table"), normalize_identifier("column").alias("column")]
    hits = proposals.select(*pair).join(forbidden.select(*pair).distinct(), ["table", "column"], "left_semi").agg(F.count("*").alias("n_hits"))
    return hits.withColumn("score", F.when(F.col("n_hits") == 0, 1.0).otherwise(0.0))


def calibration(proposals: DataFrame, golden: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """(n_right, n_wrong, margin): mean confidence of right proposals less that of wrong ones, those on
    gaps included, within 0 and 1; 1.0 when nothing is wrong."""
    return _margin(_scored(proposals, golden, gaps))


def _margin(p: DataFrame) -> DataFrame:
    one = p.agg(F.count_if("right").alias("n_right"), F.count_if(~F.col("right")).alias("n_wrong"), F.avg(F.when(F.col("right"), F.col("confidence"))).alias("r"), F.avg(F.when(~F.col("right"), F.col("confidence"))).alias("w"))
    margin = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("r", F.lit(0.0)) - F.col("w")))
    return one.select("n_right", "n_wrong", F.when(F.col("n_wrong") == 0, 1.0).otherwise(margin).alias("margin"))


# The answers of a resolution that merge nothing.
NEW, SAME_AS, UNRESOLVED = "NEW", "same_as_candidate", "unresolved"


def key_ref(c: Column | str) -> Column:
    """The normalised key column of an answer's key: of ``entity::column (gloss)`` the column. A composite
    key stays whole, so it meets no golden key of a single column."""
    c = F.col(c) if isinstance(c, str) else c
    column = F.when(F.contains(c, F.lit("::")), F.substring(c, F.locate("::", c) + 2, F.length(c))).otherwise(c)
    return normalize_identifier(F.trim(F.regexp_replace(column, r"\s*\([^()]*\)\s*$", "")))


def _answers(resolutions: DataFrame) -> DataFrame:
    return resolutions.withColumn("key", key_ref("key"))


def _expected(golden: DataFrame) -> DataFrame:
    """Golden answers by normalised key; keys are then to be unique."""
    return golden.withColumn("key", normalize_identifier("key"))


def false_merge_rate(resolutions: DataFrame, golden: DataFrame) -> DataFrame:
    """(n_merges, n_false, score): merges on golden keys that differ from the golden answer; one is
    enough for a score of 0. New, same-as and unresolved answers merge nothing; merges on other keys
    aren't judged. Keys are compared by ``key_ref``."""
    g = _expected(golden).select("key", F.col("resolution").alias("expected"))
    met = _answers(resolutions).join(g, "key").where(~F.col("resolution").isin(NEW, SAME_AS, UNRESOLVED))
    one = met.agg(F.count("*").alias("n_merges"), F.count_if(F.col("resolution") != F.col("expected")).alias("n_false"))
    return one.withColumn("score", F.when(F.col("n_false") > 0, 0.0).otherwise(1.0))


def resolution_accuracy(resolutions: DataFrame, golden: DataFrame) -> DataFrame:
    """(n_golden, n_right, accuracy): keys whose answers are all the golden one, for same-as answers with
    the golden target; no answer and answers that differ are wrong."""
    g = _expected(golden).select("key", F.col("resolution").alias("want"), F.col("same_as").alias("want_as"))
    same = F.col("resolution") == F.col("want")
    ok = same & ((F.col("want") != SAME_AS) | F.col("same_as").eqNullSafe(F.col("want_as")))
    met = g.join(_answers(resolutions), "key", "left").groupBy("key").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"))
    return met.agg(F.count("*").alias("n_golden"), F.count_if("ok").alias("n_right")).withColumn("accuracy", _ratio(F.col("n_right"), F.col("n_golden"), 1.0))


def non_merge_recall(resolutions: DataFrame, golden: DataFrame) -> DataFrame:
    """(n_golden, n_found, recall) of golden keys that must not be merged (new or same-as): found when
    every answer on them is the golden one."""
    g = _expected(golden).where(F.col("resolution").isin(NEW, SAME_AS)).select("key", F.col("resolution").alias("want"))
    ok = F.col("resolution") == F.col("want")
    met = g.join(_answers(resolutions), "key", "left").groupBy("key").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok"))
    return met.agg(F.count("*").alias("n_golden"), F.count_if("ok").alias("n_found")).withColumn("recall", _ratio(F.col("n_found"), F.col("n_golden"), 1.0))


def resolution_calibration(resolutions: DataFrame, golden: DataFrame) -> DataFrame:
    """(n_right, n_wrong, margin): mean confidence of right answers (key, resolution, confidence) on golden
    keys less that of wrong ones, within 0 and 1; 1.0 when nothing is wrong, 0.0 when nothing is right."""
    g = _expected(golden).select("key", F.col("resolution").alias("want"))
    p = _answers(resolutions).join(g, "key").withColumn("right", F.col("resolution").eqNullSafe(F.col("want")))
    return _margin(p)


def score_stats(scores: DataFrame) -> DataFrame:
    """(scorer, n, mean, min, max) over repeats (scorer, score)."""
    return scores.groupBy("scorer").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"))


#: Kinds of review items that block agreement.
BLOCKING = ("validation_error", "contract_owner")


def rollup_issues(issues: DataFrame, threshold: int = 3) -> DataFrame:
    """Review items (kind, item) by kind: groups of up to ``threshold`` keep their items, larger ones
    their number and first two; ``signoff`` says that the kind blocks.

    Items are cut to the first ones in each of many slices first, so no group is gathered whole."""
    from pyspark.sql import Window

    counts = issues.groupBy("kind").agg(F.count("*").alias("n"))
    w = Window.partitionBy("kind", F.pmod(F.xxhash64("item"), F.lit(64))).orderBy("item")
    few = issues.withColumn("_kv_k", F.row_number().over(w)).where(F.col("_kv_k") <= threshold)
    items = few.groupBy("kind").agg(F.sort_array(F.collect_list("item")).alias("i"))
    shown = F.when(F.col("n") <= threshold, F.col("i")).otherwise(F.slice("i", 1, 2))
    return counts.join(items, "kind").select("kind", "n", F.array_join(shown, ", ").alias("items"), (F.col("n") > threshold).alias("collapsed"), F.col("kind").isin(*BLOCKING).alias("signoff"))


#: Kinds of tokens that a call is billed for.
TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


def usage_rollup(calls: DataFrame) -> DataFrame:
    """(model, calls, and the sums of TOKENS) from trace rows with these columns, which count disjoint
    tokens. Older rows have no counts of a kind, or ``calls`` lacks its column: these add 0. Rows
    without a model count as ``unknown``."""
    model = F.coalesce("model", F.lit("unknown")).alias("model")
    held = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) if c in calls.columns else F.lit(0).cast("long").alias(c) for c in TOKENS]
    return calls.groupBy(model).agg(F.count("*").alias("calls"), *held)


def read_usage(spark, path: str) -> DataFrame:
    """Trace rows from JSON-lines files, with a fixed schema."""
    return spark.read.schema(", ".join(["model string", *(f"{c} long" for c in TOKENS)])).json(path)
