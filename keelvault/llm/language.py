"""Language identification: script ranges, per-word scores, and Viterbi over languages with a switching penalty.

Languages and their statistics are learned from labelled texts. The script of a word narrows the
languages that it can be of; among those its score comes from its character runs. Viterbi labels
every word so that spans of one language come out whole, also in texts that mix languages."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelvault.llm.common import documents, held_out

#: At most so many texts of a language are learned from, each as a whole, in slices of a language.
SAMPLE_TEXTS, SLICES = 400, 16
#: Characters that are worked on at a time; one longer text is a part of its own.
PART_CHARS = 1_000_000
BUCKETS = 2**16
GRAMS = (2, 3, 4)
#: What a change of language between two words costs, in units of log-probability.
SWITCH = 6.0
#: Scripts: (name, first and last code point), for letters; others are of script 0.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
NAMES = ("other", *dict.fromkeys(s for s, _, _ in SCRIPTS))

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))
FOUND = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


#: Code points from here on are no letters (planes 0 to 3 have all scripts).
LIMIT = 0x40000


def char_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: the letter or mark in lower case (0 for all else), its script, whether it is a letter."""
    lower = np.zeros(LIMIT, np.uint32)
    script = np.zeros(LIMIT, np.uint8)
    letter = np.zeros(LIMIT, bool)
    for c in range(LIMIT - 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low = chr(c).lower()
            lower[c] = ord(low) if len(low) == 1 else c
            letter[c] = kind == "L"
    for name, first, last in SCRIPTS:
        script[first : last + 1] = NAMES.index(name)
    return lower, script, letter


def letters_and_words(texts: list[str], lower: np.ndarray, letter: np.ndarray):
    """All texts as one array of lower-case letters and marks (0 elsewhere), where each text starts,
    and the words (runs that hold a letter) as start, end and text."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    starts = np.cumsum([0] + [len(p) + 1 for p in points])  # a gap after each text
    flat = np.zeros(starts[-1] + 1, np.uint32)
    for p, s in zip(points, starts, strict=False):
        flat[s : s + len(p)] = p
    flat = np.minimum(flat, LIMIT - 1)
    letters = lower[flat]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (letters > 0).astype(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    if len(begin):
        real = np.logical_or.reduceat(letter[flat], begin)
        begin, end = begin[real], end[real]
    return letters, starts, begin, end, np.searchsorted(starts, begin, side="right") - 1


def gram_buckets(letters: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Buckets of the character runs of all words (a border on both sides), one array for each length
    of run, made as it is asked for; and where each word's start."""
    lengths = end - begin + 2
    first = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    chars = np.full(total + max(GRAMS), 1, np.uint32)  # 1 stands for a border
    inside = np.ones(total, bool)
    inside[first] = inside[first + lengths - 1] = False
    at = np.repeat(begin - first - 1, lengths) + np.arange(total)
    chars[:total][inside] = letters[at[inside]]
    left = np.repeat(first + lengths, lengths) - np.arange(total)

    def buckets():
        for n in GRAMS:
            h = np.full(total, n, np.uint32)
            for i in range(n):
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + chars[i : total + i]
            h = ((h ^ (h >> np.uint32(16))) * np.uint32(0x297A2D39)) >> np.uint32(16)
            h[left < n] = BUCKETS  # runs over the border have no weight
            yield h.view(np.int32)

    return buckets(), first


def parts(texts: list[str], chars: int) -> Iterator[list[str]]:
    """``texts`` in parts of about ``chars`` characters; a longer text is a part of its own."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def count_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket and each script occurs in the words of ``texts``."""
    lower, script, letter = char_tables()
    counts = np.zeros(BUCKETS, np.int64)
    scripts = np.zeros(len(NAMES), np.int64)
    for part in parts(texts, PART_CHARS):
        letters, _, begin, end, _ = letters_and_words(part, lower, letter)
        if len(begin):
            for b in gram_buckets(letters, begin, end)[0]:
                counts += np.bincount(b, minlength=BUCKETS + 1)[:BUCKETS]
            scripts += np.bincount(script[letters[begin]], minlength=len(NAMES))
    return counts, scripts


def fit(docs: DataFrame, labels: Column, texts: int = SAMPLE_TEXTS) -> dict:
    """Languages, their bucket weights and the scripts they use, from rows outside the held-out fold
    with a label and a text: of each language the ``texts`` distinct rows (id and text) with the
    smallest hash, each text as a whole.

    Equal rows count once, rows that share an id but not the text are rows of their own, and a null
    id is like any other. Tasks count slices of a language's sample; what comes to the driver is one
    table of counts (512 KB) a language."""
    from pyspark.sql import Window

    own = F.xxhash64("doc_id", "text")
    rows = docs.where(~held_out(F.col("doc_id")) & labels.isNotNull() & F.col("text").isNotNull())
    keys = rows.select(labels.alias("lang"), own.alias("h")).distinct()
    # A language's smallest hashes: each slice of them keeps its own, then the language keeps its own.
    few = keys.withColumn("k", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("h"), F.lit(8))).orderBy("h"))).where(F.col("k") <= texts)
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= texts)
    chosen = F.broadcast(few.select(F.col("lang").alias("_kv_lang"), F.col("h").alias("_kv_h")))  # at most ``texts`` a language
    sample = rows.select(labels.alias("lang"), own.alias("h"), "text").join(chosen, (F.col("lang") == F.col("_kv_lang")) & (F.col("h") == F.col("_kv_h")), "left_semi")
    sample = sample.dropDuplicates(["lang", "h"]).select("lang", F.pmod("h", F.lit(SLICES)).alias("slice"), "text")

    def count(group):
        import pandas as pd

        counts, scripts = count_grams(group["text"].tolist())
        return pd.DataFrame({"lang": group["lang"][:1], "counts": [counts.tobytes()], "scripts": [scripts.tobytes()]})

    def unite(group):
        import pandas as pd

        sums = {c: sum(np.frombuffer(x, np.int64) for x in group[c]) for c in ("counts", "scripts")}
        return pd.DataFrame({"lang": group["lang"][:1]} | {c: [x.tobytes()] for c, x in sums.items()})

    kinds = "lang string, counts binary, scripts binary"
    got = sample.groupBy("lang", "slice").applyInPandas(count, kinds).groupBy("lang").applyInPandas(unite, kinds).collect()
    got.sort(key=lambda r: r["lang"])
    counts = np.array([np.frombuffer(r["counts"], np.int64) for r in got], np.float64).reshape(len(got), BUCKETS)
    scripts = np.array([np.frombuffer(r["scripts"], np.int64) for r in got], np.float64).reshape(len(got), len(NAMES))
    weights = np.zeros((BUCKETS + 1, len(got)), np.float32)
    if len(got):
        # Log-probabilities, each less the mean over languages: what a run says for one against the others.
        smooth = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
        weights[:BUCKETS] = np.clip(smooth - smooth.mean(axis=0), -3, 3).T
    uses = scripts >= 0.01 * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return {"langs": [r["lang"] for r in got], "weights": weights, "uses": uses.T}


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word: texts are runs of rows of ``scores``; they go forward together, one
    word a step, longest first so that those that have ended drop out at the end of the arrays."""
    n, k = scores.shape
    path = np.zeros(n, np.int32)
    if not n or k < 2:
        return path
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts longer than t
    best = scores[starts[: alive[0]]].copy()
    stay = np.empty((n, k), bool)  # whether the word before has the same language
    top = np.zeros(n, np.int32)  # the best language of the word before
    for t in range(1, steps):
        m = alive[t]
        at = starts[:m] + t
        high = best[:m].argmax(axis=1)
        away = best[np.arange(m), high] - switch
        same = best[:m] >= away[:, None]
        stay[at] = same
        top[at] = high
        best[:m] = np.where(same, best[:m], away[:, None]) + scores[at]
    last = starts + lengths - 1
    some = lengths > 0
    path[last[some]] = best[: int(some.sum())].argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        at = starts[: alive[t]] + t
        now = path[at]
        path[at - 1] = np.where(stay[at, now], now, top[at])
    return path


def tagger(sent, switch: float = SWITCH):
    """text -> FOUND as a column function; ``sent`` is a model that was broadcast."""

    def tag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lower, script, letter = char_tables()
        langs, weights, uses = (sent.value[x] for x in ("langs", "weights", "uses"))
        k = len(langs)
        for batch in batches:
            texts = [v.as_py() or "" for v in batch]
            names, scores, spans = [], [], []
            for part in parts(texts, 8 * PART_CHARS // max(4, k)):  # a word takes a row of as many numbers as there are languages
                letters, text_starts, begin, end, owner = letters_and_words(part, lower, letter)
                per_text = np.bincount(owner, minlength=len(part)) if len(owner) else np.zeros(len(part), np.int64)
                word_starts = np.cumsum(per_text) - per_text
                path = np.zeros(len(begin), np.int32)
                if len(begin) and k:
                    table = np.zeros((len(begin), k), np.float32)
                    buckets, first = gram_buckets(letters, begin, end)
                    for b in buckets:
                        table += np.add.reduceat(weights.take(b, axis=0), first, axis=0)
                    table /= len(GRAMS)
                    can = uses[script[letters[begin]]]
                    table[~can & can.any(axis=1)[:, None]] -= 30
                    path = viterbi(table, word_starts, per_text, switch)
                weight = end - begin
                wide = max(k, 1)
                share = np.bincount(owner * wide + path, weights=weight, minlength=len(part) * wide).reshape(len(part), wide)
                change = np.ones(len(begin), bool)
                change[1:] = (path[1:] != path[:-1]) | (owner[1:] != owner[:-1])
                heads = np.flatnonzero(change)
                tails = np.append(heads[1:], len(begin))[: len(heads)] - 1
                bounds = np.searchsorted(owner[heads], np.arange(len(part) + 1))
                span_start = (begin[heads] - text_starts[owner[heads]]).tolist()
                span_end = (end[tails] - text_starts[owner[heads]]).tolist()
                span_lang = path[heads].tolist()
                totals = share.sum(axis=1)
                winners = share.argmax(axis=1)
                for i in range(len(part)):
                    if not k or not totals[i]:
                        names.append("und")
                        scores.append(0.0)
                        spans.append([])
                        continue
                    names.append(langs[winners[i]])
                    scores.append(float(share[i, winners[i]] / totals[i]))
                    spans.append([{"start": span_start[j], "end": span_end[j], "lang": langs[span_lang[j]]} for j in range(bounds[i], bounds[i + 1])])
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, _SPANS)], names=["lang", "score", "spans"])

    return F.arrow_udf(tag, FOUND).asNondeterministic()


def identify(docs: DataFrame, model: dict, switch: float = SWITCH) -> DataFrame:
    """``docs`` with ``language``: the language with most letters, its share of all letters, and the
    spans (code points, end exclusive) of one language each.

    A null text and one without letters are ``und`` with score 0 and no spans. On equal shares the
    language first by name wins. Without labelled texts everything is ``und``. Texts of any length
    are read whole. Rows are independent; a column language is replaced; an empty table gives an
    empty table. The model (256 KB a language) is broadcast."""
    return docs.withColumn("language", tagger(docs.sparkSession.sparkContext.broadcast(model), switch)("text"))


def op2_language_spans(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.select("doc_id", "text", "lang"), F.col("lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
