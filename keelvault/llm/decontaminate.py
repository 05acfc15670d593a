"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

Items are cut into windows of 13 consecutive words (an item of fewer words is one window). The
automaton runs over word numbers, so a document is scanned once whatever the number of windows;
hits are mapped back to character offsets of the original text. A benchmark that is too large for
one automaton is dealt to slices; these are scanned for one after another, and the hits of equal
texts are united, so neither the driver nor a task ever holds more than one slice."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelvault.llm.common import documents, stored

#: ASCII other than digits and letters ends a word and A-Z become lower case; all other bytes are of words.
_NORMAL = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A slice of the benchmark of about so many words becomes one automaton (about 100 bytes a window word).
SLICE_WORDS = 500_000
#: Hits of up to so many distinct texts are broadcast to the documents; beyond, both are shuffled.
BROADCAST_HITS = 20_000

SCAN = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("n_items", T.LongType()),
    ]
)
_ARROW = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("n_items", pa.int64())])


def normal_words(text: str | None) -> list[bytes]:
    """Words of ``text`` with A-Z in lower case, as UTF-8 bytes."""
    return (text or "").encode().translate(_NORMAL).split()


def sliced(bench: DataFrame, slice_words: int) -> tuple[DataFrame, int]:
    """The distinct items (item_id, text) with the slice that each is dealt to, and the number of slices."""
    items = bench.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").rlike(WORD)).distinct()
    words = items.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    n = max(1, -(-words // slice_words))
    return items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), n


class Scanner:
    """The automaton of a slice of items."""

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        import ahocorasick

        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            numbers = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in normal_words(text)]
            for i in range(max(1, len(numbers) - width + 1)):
                owners.setdefault(tuple(numbers[i : i + width]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if owners else None
        if self.automaton is not None:
            for window, whose in owners.items():
                self.automaton.add_word(window, (len(window), whose))
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[int], set[str | None]]:
        """Number of words, numbers of the hit words, items found."""
        words = text.translate(_NORMAL).split()
        covered: set[int] = set()
        found: set[str | None] = set()
        if words and self.automaton is not None:
            for end, (n, owner) in self.automaton.iter(tuple(map(self.vocab.get, words, repeat(0)))):
                covered.update(range(end - n + 1, end + 1))
                found |= owner
        return len(words), sorted(covered), found


_SCANNERS: dict[str, Scanner] = {}


def scanner(key: str, sent, width: int):
    """text -> SCAN for one slice of items, as a column function. ``sent`` holds the items, broadcast;
    a Python worker makes the automaton once and keeps that of one slice only."""

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _SCANNERS:
            _SCANNERS.clear()
            _SCANNERS[key] = Scanner(sent.value, width)
        one = _SCANNERS[key]
        for batch in batches:
            counts, hits, found, n_found = [], [], [], []
            for value in batch.cast(pa.binary()):
                n, covered, items = one.scan(value.as_py() or b"")
                counts.append(n)
                hits.append(covered)
                found.append(sorted(x for x in items if x is not None))
                n_found.append(len(items))
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string())), pa.array(n_found, pa.int64())], fields=list(_ARROW))

    return F.arrow_udf(scan, SCAN).asNondeterministic()


def slice_scanner(items: DataFrame, number: int, width: int):
    """The column function of one slice; its items come to the driver and are broadcast."""
    rows = [tuple(r) for r in items.where(F.col("slice") == number).select("item_id", "text").collect()]  # about SLICE_WORDS words
    sent = items.sparkSession.sparkContext.broadcast(rows)
    return scanner(f"{id(sent)}-{number}-{hash(tuple(rows))}", sent, width), sent


def scan(docs: DataFrame, bench: DataFrame, width: int = 13, slice_words: int = SLICE_WORDS) -> DataFrame:
    """``docs`` with ``scan``: the number of words, the numbers of hit words, the ids of the items found
    (sorted as text), and their number.

    A word is hit if it lies inside any occurrence of a window. Null and empty texts and items have
    no words; an empty benchmark or one without words hits nothing, and an empty table gives an empty
    table. Items with equal texts are separate items; rows that share an id are one item; items with
    the null id hit words and count as one item, but have no id to list. Texts are scanned whole,
    rows are independent, and a column of docs named scan is replaced."""
    out = docs.drop("scan")
    items, n = sliced(bench, slice_words)
    if n == 1:
        return out.withColumn("scan", slice_scanner(items, 0, width)[0](F.col("text")))
    items = stored(items, "items")
    key = F.sha2("text", 256)
    found = None
    for number in range(n):
        column, sent = slice_scanner(items, number, width)
        part = out.select("text").withColumn("s", column(F.col("text"))).where(F.size("s.hits") > 0)
        part = stored(part.select(key.alias("_kv_text"), "s.hits", "s.items", (F.col("s.n_items") > F.size("s.items")).alias("nameless")).dropDuplicates(["_kv_text"]), "hits")
        found = part if found is None else found.unionByName(part)
        sent.destroy()
    united = found.groupBy("_kv_text").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("nameless").alias("nameless"))
    united = stored(united, "united")  # a group has a row a slice at most
    united = F.broadcast(united) if united.count() <= BROADCAST_HITS else united
    met = out.withColumn("_kv_own", key).join(united, F.col("_kv_own") == F.col("_kv_text"), "left")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    one = F.struct(words.alias("n_words"), F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), listed.alias("items"), (F.size(listed) + F.coalesce("nameless", F.lit(False)).cast("int")).cast("long").alias("n_items"))
    return met.withColumn("scan", one).select(*[F.col(f"`{c}`") for c in out.columns], "scan")


def contaminated(scanned: Column, share: int = 20) -> Column:
    """At least one hit word, and at least one word in ``share`` is hit."""
    n = F.size(scanned["hits"])
    return (n > 0) & (n * share >= scanned["n_words"])


def decontaminate(docs: DataFrame, bench: DataFrame, width: int = 13) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns of ``docs`` (also one named scan).

    Null and empty texts stay; rows that repeat an id are judged one by one, by their texts."""
    plain = docs.withColumnRenamed("scan", "_kv_own_scan") if "scan" in docs.columns else docs
    kept = scan(plain, bench, width).where(~contaminated(F.col("scan"))).drop("scan")
    return kept.withColumnRenamed("_kv_own_scan", "scan")


def hit_spans(text: str | None, hits: list[int]) -> list[tuple[int, int]]:
    """Character spans (end exclusive) in the original text of runs of hit words."""
    spans: list[tuple[int, int]] = []
    places = [m.span() for m in re.finditer(WORD, text or "")]
    last = None
    for h in hits:
        if last == h - 1:
            spans[-1] = (spans[-1][0], places[h][1])
        else:
            spans.append(places[h])
        last = h
    return spans


def span_column(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for texts, hits in batches:
        yield pa.array([[{"start": a, "end": b} for a, b in hit_spans(t.as_py(), h.as_py())] for t, h in zip(texts, hits, strict=True)], kind)


def hit_passages(docs: DataFrame, bench: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, start, end, passage): the hit runs of each document as spans of its original text (code points,
    end exclusive), whatever its length. Null and empty texts, an empty table and an empty benchmark give
    no rows; rows that are equal or share an id give theirs each. Other columns are not read."""
    spans = F.arrow_udf(span_column, "array<struct<start:int,end:int>>").asNondeterministic()
    scanned = scan(docs.select("doc_id", "text"), bench, width).where(F.size("scan.hits") > 0)
    rows = scanned.select("doc_id", "text", F.explode(spans("text", "scan.hits")).alias("s"))
    return rows.select("doc_id", "s.start", "s.end", F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("passage"))


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    s = F.col("scan")
    return scan(documents(spark, sf_dir).select("doc_id", "text"), bench).select(
        "doc_id",
        s["n_words"].alias("n_words"),
        F.size(s["hits"]).cast("long").alias("n_hit"),
        s["n_items"].alias("n_items"),
        F.sha2(F.array_join(s["items"], ","), 256).alias("items_sha256"),
        contaminated(s).alias("contaminated"),
    )


ORACLE_OP9 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw))
), m AS (
  SELECT doc_id, p, n, item_id FROM dw JOIN iw USING (n, g)
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM m)) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
