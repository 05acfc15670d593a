"""Quality rules by cross-document line frequency, with DataFrame functions only.

Lines are normalised and hashed; for every host (source) the number of documents that hold a line
is counted. Lines above the limit are removed, and a document is rejected when too little is left.
A few per-document rules come first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelvault.llm.common import documents, let, stored

#: A line is removed if more documents of its host hold it, whatever the size of the host.
MIN_DOCUMENTS = 10
#: Up to so many frequent lines are broadcast; beyond, they are joined by shuffle, where Spark splits hot lines.
BROADCAST_LINES = 200_000
#: A document is rejected if fewer words, or a smaller share of its words, are left.
MIN_WORDS_LEFT, MIN_SHARE_LEFT = 20, 0.5


def neighbours(hashes: Column, step: int) -> Column:
    """Hashes of each element with the one ``step`` places on."""
    n = F.size(hashes) - step
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, step + 1, n), lambda a, b: F.xxhash64(a, b))


def repeat_words(w: Column) -> Column:
    """Words of the array ``w`` that lie in a window of 8 words found twice or more in it.

    Hashes of 8 words are made from those of 4, and these from those of 2. Two equal windows give
    five repeated runs of 4 words, so texts with fewer need no more work."""
    width = 8

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            at = F.transform(s, lambda e, k: F.when((e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"]), e["i"]))
            return F.sort_array(F.filter(at, lambda x: x.isNotNull()))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return let(let(placed, twice), total)

    def windows(fours: Column) -> Column:
        some = let(neighbours(fours, 4), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
        return F.when(F.size(fours) - F.size(F.array_distinct(fours)) < 5, F.lit(0)).otherwise(some)

    fours = let(let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: neighbours(h, 1)), lambda h: neighbours(h, 2))
    return F.when(F.size(w) <= width, F.lit(0)).otherwise(let(fours, windows))


def spaced(text: Column) -> Column:
    """A text with all white space but line ends as spaces; null is empty."""
    text = F.coalesce(text, F.lit(""))
    for c in "\t\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def line_hash(line: Column) -> Column:
    """64-bit hash of a line in lower case and without white space."""
    return F.xxhash64(F.lower(F.replace(line, F.lit(" "), F.lit(""))))


def measures(text: Column) -> Column:
    """One struct: n, chars, repeated, dup_lines (0 for null and empty texts) and, for each line
    that holds a word, its hash and its number of words."""

    def whole(lines: Column, parts: Column) -> Column:
        own = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda _, i: F.size(F.get(parts, i)) > 0)
        shaped = F.zip_with(lines, parts, lambda x, p: F.struct(line_hash(x).alias("line"), F.size(p).alias("n"), F.length(F.replace(x, F.lit(" "), F.lit(""))).alias("c")))
        return F.struct(
            F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + F.size(p)).alias("n"),
            F.aggregate(shaped, F.lit(0).cast("long"), lambda a, x: a + x["c"]).alias("chars"),
            let(F.flatten(parts), repeat_words).cast("long").alias("repeated"),
            let(own, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("dup_lines"),
            F.transform(F.filter(shaped, lambda x: x["n"] > 0), lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"))).alias("lines"),
        )

    split = F.split(spaced(text), "\n", -1)
    return let(split, lambda lines: let(F.transform(lines, lambda x: F.array_remove(F.split(x, " "), "")), lambda parts: whole(lines, parts)))


def measured(docs: DataFrame) -> DataFrame:
    """One narrow row a document, written once: all later steps read it instead of the texts."""
    symbols = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[#*$%&|<>]")).cast("long")
    rows = docs.select("doc_id", "source", F.xxhash64("text", "source").alias("_kv_own"), symbols.alias("n_symbols"), measures(F.col("text")).alias("_kv_m"))
    return stored(rows, "measures")


def frequent_lines(rows: DataFrame) -> DataFrame:
    """(source, line): hashes of the lines that more distinct documents of the source hold than the limit.

    Rows with one id are one document, also those with the null id."""
    each = rows.select("source", F.struct("doc_id").alias("id"), F.explode(F.array_distinct(F.transform("_kv_m.lines", lambda x: x["line"]))).alias("line"))
    often = each.groupBy("source", "line").agg(F.count_distinct("id").alias("_kv_docs")).where(F.col("_kv_docs") > MIN_DOCUMENTS)
    often = stored(often.select("source", "line"), "frequent")
    return F.broadcast(often) if often.count() <= BROADCAST_LINES else often


def removed_words(rows: DataFrame) -> DataFrame:
    """(_kv_id, _kv_text, _kv_removed, _kv_lines): for documents with frequent lines, keyed by id and
    text hash, the words in such lines and their hashes."""
    each = rows.select(F.col("doc_id").alias("_kv_id"), F.col("_kv_own").alias("_kv_text"), "source", F.posexplode("_kv_m.lines").alias("pos", "x")).select("*", "x.line", "x.n").drop("x")
    often = frequent_lines(rows).select(F.col("source").alias("_kv_host"), F.col("line").alias("_kv_line"))
    hit = each.join(often, (F.col("line") == F.col("_kv_line")) & F.col("source").eqNullSafe(F.col("_kv_host")), "left_semi")
    # Rows that repeat id and text give each position once.
    once = hit.groupBy("_kv_id", "_kv_text", "pos").agg(F.max("n").alias("n"), F.max("line").alias("line"))
    return once.groupBy("_kv_id", "_kv_text").agg(F.sum("n").cast("long").alias("_kv_removed"), F.collect_set("line").alias("_kv_lines"))


def verdicts(rows: DataFrame) -> DataFrame:
    removed = removed_words(rows)
    m = F.col("_kv_m")
    joined = rows.join(removed, F.col("doc_id").eqNullSafe(F.col("_kv_id")) & (F.col("_kv_own") == F.col("_kv_text")), "left")
    out = joined.select(
        "doc_id",
        "_kv_own",
        "_kv_lines",
        m["n"].alias("n_words"),
        m["chars"].alias("word_chars"),
        "n_symbols",
        m["dup_lines"].alias("n_dup_lines"),
        m["repeated"].alias("n_repeat_words"),
        (m["n"] - F.coalesce("_kv_removed", F.lit(0))).alias("n_words_left"),
    )
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    left = (F.col("n_words_left") >= MIN_WORDS_LEFT) & (F.col("n_words_left") >= F.col("n_words") * MIN_SHARE_LEFT)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & left)


def judge(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: its id, the base measures, base_failed, what the removal of
    frequent lines leaves (``n_words_left``), and ``kept``.

    A null or empty text has no words and fails the base rules. Rows with one id (or none) are one
    document of their host in the counts, and each gets the result of its own text; equal rows get
    equal results. The null source is a host. Texts of any length are measured whole. An empty table
    gives an empty table; columns other than doc_id, text and source are not read."""
    return verdicts(measured(docs.select("doc_id", "text", "source"))).drop("_kv_own", "_kv_lines")


def clean(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs``, their text without the frequent lines, other columns as they are.

    Rows are judged as by ``judge``: null, empty and depleted texts go, every row of a repeated id is
    kept or not by its own text, and an empty table gives an empty table. The rest of a text keeps
    its lines as they were, also those without words; columns of any name are kept."""
    kept = verdicts(measured(docs.select("doc_id", "text", "source"))).where("kept")
    kept = kept.select(F.col("doc_id").alias("_kv_id"), F.col("_kv_own").alias("_kv_text"), "_kv_lines").dropDuplicates(["_kv_id", "_kv_text"])
    keyed = docs.withColumn("_kv_own", F.xxhash64("text", "source"))
    joined = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("_kv_id")) & (F.col("_kv_own") == F.col("_kv_text")))
    rest = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains(F.col("_kv_lines"), line_hash(spaced(x))))
    text = F.when(F.col("_kv_lines").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    return joined.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_line_frequency(spark, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


ORACLE_OP1 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) > 8)
), rep AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), rw AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM rep) GROUP BY doc_id
), ln AS (
  SELECT doc_id, source, l FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM ln GROUP BY doc_id
), nl AS (
  SELECT doc_id, source, lower(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS k, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS nw FROM ln
), f AS (
  SELECT source, k FROM nl GROUP BY source, k HAVING count(DISTINCT doc_id) > 10
), gone AS (
  SELECT doc_id, sum(nw) AS n FROM nl JOIN f ON nl.source IS NOT DISTINCT FROM f.source AND nl.k = f.k GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words,
    CAST(len(w) - coalesce(gone.n, 0) AS BIGINT) AS n_words_left
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words_left >= 20 AND n_words_left >= 0.5 * n_words AS kept FROM m
"""
