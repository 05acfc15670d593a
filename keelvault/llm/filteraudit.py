"""How filters of documents interact: failing-id relations, joined for every order of the filters.

1. One pass over the texts says which filters a document fails; each filter's failing ids become a
   table of their own.
2. A left-semi join with a filter's table gives the documents that it removes, a left-anti join those
   that it leaves. Each filter splits the documents in this way, so after the last one every
   document is in the cell of the filters that it fails, and every set of filters that can come
   first in some order has its survivors as a union of cells.
3. Cells are counted by part: as many rows as there are parts and sets of filters, whatever the
   number of documents. All orders are read off these counts.

``trace`` follows one order instead and gives the ids that each of its steps removes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelvault.llm.common import WORD, documents, stored, word_count

#: A document is known by these columns: its id, and what tells rows of one id apart.
KEY = ("doc_id", "digest", "part")


def few_words(least: int = 200) -> Column:
    return word_count(F.col("text")) < least


def few_distinct_words(percent: int = 50) -> Column:
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    return F.transform(F.array(words), lambda w: 100 * F.size(F.array_distinct(w)) < percent * F.size(w))[0]


def many_capitals(percent: int = 3) -> Column:
    return 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > percent * F.length("text").cast("long")


def odd_signs() -> Column:
    return F.col("text").rlike("[#$%&*|]")


#: The filters that look at a single text, by letter; E, copies, looks at all texts.
RULES = {"A": few_words, "B": few_distinct_words, "C": many_capitals, "D": odd_signs}
COPIES = "E"


def facts(docs: DataFrame, labels: DataFrame, part: str, rules: Mapping[str, Column]) -> DataFrame:
    """(doc_id, digest, part, n, good, toxic, fails): documents, rows that are equal in id, text and
    part as one with their number; ``fails`` holds the letters of ``rules`` that the text breaks."""
    plain = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    fails = F.concat(F.lit(""), *[F.when(c, k).otherwise("") for k, c in rules.items()])
    rows = plain.select("doc_id", F.sha2("text", 256).alias("digest"), "part", fails.alias("fails"))
    rows = rows.groupBy(*KEY, "fails").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_kv_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    out = rows.join(marks, F.col("doc_id") == F.col("_kv_id"), "left")
    return stored(out.select(*KEY, "n", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")), "facts")


def failing_ids(rows: DataFrame, letters: Sequence[str]) -> dict[str, DataFrame]:
    """One stored table of ids for each letter: the documents that break its rule; for copies those
    whose text a document with a smaller id has."""
    out = {}
    for k in letters:
        if k == COPIES:
            first = rows.groupBy("digest").agg(F.min("doc_id").alias("_kv_first"), F.max("doc_id").alias("_kv_last")).where("_kv_first < _kv_last")
            ids = rows.join(first.select(F.col("digest").alias("_kv_digest"), "_kv_first"), (F.col("digest") == F.col("_kv_digest")) & (F.col("doc_id") > F.col("_kv_first")))
        else:
            ids = rows.where(F.contains("fails", F.lit(k)))
        out[k] = stored(ids.select(*KEY), f"fails_{k}")
    return out


def _same(ids: DataFrame) -> tuple[DataFrame, Column]:
    other = ids.select(*[F.col(c).alias(f"_kv_{c}") for c in KEY])
    return other, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_kv_{c}")) for c in KEY])


def removed(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of ``rows`` that a filter removes."""
    other, same = _same(ids)
    return rows.join(other, same, "left_semi")


def survivors(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of ``rows`` that a filter leaves."""
    other, same = _same(ids)
    return rows.join(other, same, "left_anti")


def trace(rows: DataFrame, tables: Mapping[str, DataFrame], order: Sequence[str]) -> DataFrame:
    """(step, filter, doc_id, digest, part, n): what each step of one order of the filters removes."""
    parts = []
    for i, k in enumerate(order, 1):
        parts.append(removed(rows, tables[k]).select(F.lit(i).alias("step"), F.lit(k).alias("filter"), *KEY, "n"))
        rows = survivors(rows, tables[k])
    return reduce(lambda a, b: a.unionByName(b), parts)


def cells(rows: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(part, cell, n, good, toxic): documents by the set of filters that they fail (a bit each, in the
    order of ``tables``), with the numbers of those labelled good and toxic."""
    rows = rows.select(*KEY, "n", "good", "toxic", F.lit(0).alias("cell"))
    for i, (k, ids) in enumerate(tables.items()):
        split = survivors(rows, ids).unionByName(removed(rows, ids).withColumn("cell", F.col("cell") + 2**i))
        rows = stored(split, f"after_{k}")  # both sides of the next filter read it
    marks = [F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    return stored(rows.groupBy("part", "cell").agg(F.sum("n").alias("n"), *marks), "cells")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", rules: Mapping[str, Column] | None = None, copies: bool = True) -> DataFrame:
    """One row for each part, order of the filters and step: (part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley), zeros included.

    ``rules`` are conditions on ``text`` by letter (the four of the query where none are given), and
    with ``copies`` E is failed by texts that a smaller doc_id has in the whole table. Null texts are
    empty, and so are equal to each other; a null part is the empty string. Rows are counted one by
    one, equal rows too; a row without an id is nobody's copy and copies nobody. Of several labels
    of an id any 1 counts; labels without an id count for none. An empty table gives no rows, and an
    empty table of labels no losses. Texts of any length are read whole. Other columns are not read.
    The number of orders is the factorial of the number of filters, so take few filters."""
    rules = {k: f() for k, f in RULES.items()} if rules is None else dict(rules)
    letters = [*rules, *([COPIES] if copies else [])]
    rows = facts(docs, labels, part, rules)
    tables = failing_ids(rows, letters)
    counts = cells(rows, tables)
    spark = docs.sparkSession
    steps = []  # by order and step: what came before, and the bit of the filter
    for order in permutations(range(len(letters))):
        before = 0
        for i, k in enumerate(order, 1):
            steps.append(("".join(letters[x] for x in order), i, before, 2**k))
            before |= 2**k
    plan = spark.createDataFrame(steps, "filter_order string, step int, before int, bit int")
    # Every cell under every step: parts times sets of filters times orders, whatever the documents.
    meets = [(b, f, c) for b, f in sorted({s[2:] for s in steps}) for c in range(2 ** len(letters))]
    cases = spark.createDataFrame(meets, "before int, bit int, cell int")
    out_before = F.col("cell").bitwiseAND(F.col("before")) != 0
    fails = F.col("cell").bitwiseAND(F.col("bit")) != 0
    goes = fails & ~out_before

    def total(c: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(c)).otherwise(0))

    by_set = counts.join(F.broadcast(cases), "cell").groupBy("part", "before", "bit").agg(
        total("n", ~fails & ~out_before).alias("kept"),
        total("n", goes).alias("removed"),
        total("n", fails & out_before).alias("redundant"),
        total("n", F.col("cell") == F.col("bit")).alias("unique_fails"),
        total("good", goes).alias("good_lost"),
        total("toxic", goes).alias("toxic_lost"),
    )
    by_set = stored(by_set, "by_set")
    full = by_set.join(F.broadcast(plan), ["before", "bit"])
    shapley = full.groupBy(F.col("part").alias("_kv_part"), F.col("bit").alias("_kv_bit")).agg(F.sum("removed").alias("shapley"))
    out = full.join(shapley, (F.col("part") == F.col("_kv_part")) & (F.col("bit") == F.col("_kv_bit")))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_OP13 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t
), f AS (
  SELECT doc_id, part, len(w) < 200 AS A, 100 * len(list_distinct(w)) < 50 * len(w) AS B, 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text) AS C,
    regexp_matches(text, '[#$%&*|]') AS D, doc_id > first_id AS E FROM w
), x AS (
  SELECT doc_id, part, unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([A, B, C, D, E]) AS fails FROM f
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), v AS (
  SELECT part, failed, count(*) AS n, CAST(sum(coalesce(good, 0)) AS BIGINT) AS good, CAST(sum(coalesce(toxic, 0)) AS BIGINT) AS toxic
  FROM (SELECT doc_id, part, coalesce(string_agg(letter, '' ORDER BY letter) FILTER (WHERE fails), '') AS failed FROM x GROUP BY doc_id, part) LEFT JOIN l USING (doc_id) GROUP BY part, failed
), o AS (
  SELECT '' AS filter_order
  UNION ALL
  SELECT filter_order || letter FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter) WHERE NOT contains(filter_order, letter)
), s AS (
  SELECT filter_order, step, substr(filter_order, 1, step - 1) AS before, substr(filter_order, step, 1) AS letter FROM o, (SELECT unnest(range(1, 6)) AS step) WHERE len(filter_order) = 5
), r AS (
  SELECT part, filter_order, step, letter, n, good, toxic, contains(failed, letter) AS fails, failed = letter AS only_this,
    len(translate(failed, before, '')) < len(failed) AS gone FROM v, s
), a AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter,
    CAST(sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN only_this THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM r GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM a
"""
