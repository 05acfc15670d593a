"""Phrase collocations by HAT-trie counting.

Phrases are counted level by level, words first. A task numbers its words and counts phrases in a
burstable trie: hash containers below a shallow trie over word numbers; a container that grows too
large bursts into one container for each next word. When a task holds more phrases than it may, its
largest subtrees leave it as sorted runs, and at the end all others do. Runs are cut by prefix
partition, and each partition merges its runs from all tasks. From the second level on a phrase is
counted only if both phrases that lack one of its end words are frequent enough, by a Bloom filter of
fixed size: what it lets through by mistake is counted as well and then dropped by its true count.

Words travel as 64-bit hashes; hashes that stand for two words of a language are looked for, and
another seed is taken if there are any, so counts are exact. The prefix of a phrase is its first
word, but for the few words that would make a partition too large: there all words of the phrase
decide, so no partition depends on one frequent word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelvault.llm.common import documents, stored

#: Phrases that a container holds before it bursts, and those that a task holds before it spills.
BURST, HELD = 4_096, 1_000_000
#: Words that a task numbers before it starts anew, and words that it counts at a time.
NUMBERED, CHUNK = 500_000, 500_000
#: The Bloom filter has 2 ** BLOOM_BITS bits (8 MB where it is broadcast) and so many hashes.
BLOOM_BITS, BLOOM_HASHES = 26, 3
#: A word whose share of all words is above 1 / (HOT * partitions) has its phrases spread by all words.
HOT = 4
UNKNOWN = "und"
#: Bits of a word's number in a packed phrase, so phrases have three words at most.
BITS, LONGEST = 21, 3

#: Separators of pieces become a line feed of its own, tabs become spaces, A-Z become a-z.
_FORM = bytes(10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pieces(text: str | None) -> list[bytes]:
    """Words of a text and a line feed at each end of a piece; empty strings between are no words."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FORM).replace(b"\n", b" \n ").split(b" ")


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def phrase_hash(lang: int, words: list[np.ndarray]) -> np.ndarray:
    """One hash of phrases whose words' hashes are ``words``, one array a place."""
    x = np.full(len(words[0]), lang, np.uint64)
    for w in words:
        x = mixed(x ^ w) + _MIX
    return mixed(x)


class Bloom:
    """A set of phrases that may say yes by mistake, never no."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # of bytes

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for i in range(BLOOM_HASHES):
            at = bloom_place(h, i)
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def bloom_place(h: np.ndarray, i: int) -> np.ndarray:
    return (mixed(h + np.uint64(i + 1)) >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)


class Trie:
    """Counts of packed phrases: a hash container (packed phrase: count) beside nodes for the next words
    that have burst out of it. A container that has outgrown its limit bursts: each next word with
    a fair share of it becomes a node, the many rare ones stay together."""

    def __init__(self, words: int, depth: int = 0):
        self.words, self.depth = words, depth
        self.table: dict[int, int] = {}
        self.nodes: dict[int, Trie] = {}
        self.limit, self.burst = BURST, np.empty(0, np.int64)

    def next_word(self, packed: np.ndarray) -> np.ndarray:
        return (packed >> (BITS * (self.words - 1 - self.depth))) & ((1 << BITS) - 1)

    def add(self, packed: np.ndarray, counts: np.ndarray) -> int:
        """Add sorted phrases; returns how many are new."""
        new = 0
        if self.nodes:
            word = self.next_word(packed)
            apart = self.burst[np.minimum(np.searchsorted(self.burst, word), len(self.burst) - 1)] == word
            some, word, held = packed[apart], word[apart], counts[apart]
            cuts = np.flatnonzero(np.diff(word)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(some)], strict=True):
                if a < b:
                    new += self.nodes[int(word[a])].add(some[a:b], held[a:b])
            packed, counts = packed[~apart], counts[~apart]
        table, before = self.table, len(self.table)
        get = table.get
        for k, n in zip(packed.tolist(), counts.tolist(), strict=True):
            table[k] = get(k, 0) + n
        new += len(table) - before
        if len(table) > self.limit and self.depth < self.words - 1:
            self.split()
        return new

    def split(self) -> None:
        keys, counts = self._table()
        word = self.next_word(keys)
        found, sizes = np.unique(word, return_counts=True)
        large = found[sizes >= BURST // 8]
        for w in large.tolist():
            own = self.nodes[w] = Trie(self.words, self.depth + 1)
            own.add(keys[word == w], counts[word == w])
        self.burst = np.array(sorted(self.nodes), np.int64)
        kept = ~np.isin(word, large)
        self.table = dict(zip(keys[kept].tolist(), counts[kept].tolist(), strict=True))
        self.limit = max(BURST, 2 * len(self.table))

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.fromiter(self.table.keys(), np.int64, len(self.table))
        counts = np.fromiter(self.table.values(), np.int64, len(self.table))
        order = np.argsort(keys)
        return keys[order], counts[order]

    def size(self) -> int:
        return len(self.table) + sum(n.size() for n in self.nodes.values())

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """All phrases in order, with their counts."""
        parts = [self._table(), *(n.sorted() for n in self.nodes.values())]
        keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")  # runs are merged
        return keys[order], counts[order]

    def spill(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Take out whole subtrees, the largest first, until ``least`` phrases are gone; the container with
        the rare words is one of them. Gives one sorted run."""
        out = Trie(self.words, self.depth)
        trees = sorted([(len(self.table), -1), *((n.size(), w) for w, n in self.nodes.items())], reverse=True)
        for size, w in trees:
            if least <= 0:
                break
            least -= size
            if w < 0:
                out.table, self.table, self.limit = self.table, {}, BURST
            else:
                out.nodes[w] = self.nodes.pop(w)
        self.burst = np.array(sorted(self.nodes), np.int64)
        return out.sorted()


def lang_number(lang: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 12)


def word_counter(seed: int, parts: int):
    """Batches of (lang, text) -> (lang, part, hashes, checks, counts, words): each task's words by prefix
    partition, in order of their hash, with a second hash, their counts, and themselves by line."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from collections import Counter

        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                found.pop(b"", None)
                found.pop(b"\n", None)
                words, counts = list(found.keys()), np.fromiter(found.values(), np.int64, len(found))
                h, check = (np.fromiter((xxhash.xxh64_intdigest(w, s) for w in words), np.uint64, len(words)) for s in (seed, seed + 1000))
                part = (phrase_hash(1, [h]) % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((h, part))
                cuts = np.flatnonzero(np.diff(part[order])) + 1
                rows = []
                for some in np.split(order, cuts):
                    if len(some):
                        rows.append((int(part[some[0]]), h[some].tobytes(), check[some].tobytes(), counts[some].tobytes(), b"\n".join([words[i] for i in some.tolist()])))
                for i in range(0, len(rows), 256):
                    columns = list(zip(*rows[i : i + 256], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(columns[0]), pa.string()), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["lang", "part", "hashes", "checks", "counts", "words"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(lang, Counter()).update(pieces(text.as_py()))
            if sum(map(len, held.values())) > NUMBERED:
                yield from flush()
        yield from flush()

    return count


def word_merger(least: int):
    """One prefix partition of a language: the words that occur ``least`` times or more, and a row without
    a word that has the number of all and says whether a hash stands for two words."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        h, check = (np.concatenate([np.frombuffer(x, np.uint64) for x in group[c]]) for c in ("hashes", "checks"))
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in group["counts"]])
        order = np.argsort(h, kind="stable")  # runs are merged
        h, check = h[order], check[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        clash = bool((np.maximum.reduceat(check, first) != np.minimum.reduceat(check, first)).any())
        sums = np.add.reduceat(counts[order], first)
        kept = np.flatnonzero(sums >= least)
        ends = np.cumsum([len(x) // 8 for x in group["hashes"]])
        lines: dict[int, list[bytes]] = {}
        words = []
        for at in order[first[kept]].tolist():  # where each of them stands
            run = int(np.searchsorted(ends, at, side="right"))
            if run not in lines:
                lines[run] = group["words"].iloc[run].split(b"\n")
            words.append(lines[run][at - int(ends[run])].decode("utf-8", "surrogatepass"))
        lang = group["lang"].iloc[0]
        own = h[first[kept]].view(np.int64).tolist()
        return pd.DataFrame({"lang": [lang] * (len(kept) + 1), "h": pd.array([*own, None], "Int64"), "word": [*words, None], "n": [*sums[kept].tolist(), int(counts.sum())], "clash": [False] * len(kept) + [clash]})

    return merge


def phrase_counter(words: int, seed: int, sent, hot, parts: int):
    """Batches of (lang, text) -> (lang, part, heads, sizes, rest, counts): sorted runs of phrases of
    ``words`` words. A run has its first words once each (heads), with the number of phrases of each
    (sizes), the hashes of the other words (rest, place by place) and the counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        bloom, frequent = Bloom(sent.value), hot.value

        class Numbers(dict):
            """Word -> its number; 0 is no word, 1 the end of a piece."""

            def __init__(self):
                super().__init__({b"": 0, b"\n": 1})
                self.new: list[bytes] = []

            def __missing__(self, word: bytes) -> int:
                self.new.append(word)
                value = self[word] = len(self)
                return value

        class Language:
            """The numbers of words, by number their hashes and whether they are frequent, the trie, and
            tokens that wait."""

            def __init__(self, lang: str):
                self.lang, self.key, self.trie = lang, lang_number(lang), Trie(words)
                self.waiting: list[bytes] = []
                self.size = 0
                self.anew()

            def anew(self) -> None:
                self.numbers, self.hashes, self.frequent = Numbers(), np.zeros(2, np.uint64), np.zeros(2, bool)

            def number(self) -> np.ndarray:
                """The waiting tokens by number."""
                tokens, self.waiting = self.waiting, []
                ids = np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens))
                new, self.numbers.new = self.numbers.new, []
                h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in new), np.uint64, len(new))
                self.hashes = np.concatenate([self.hashes, h])
                self.frequent = np.concatenate([self.frequent, bloom.has(phrase_hash(self.key, [h]))])
                return ids[ids > 0]

        held: dict[str, Language] = {}

        def count_waiting(x: Language) -> None:
            ids = x.number()
            n = len(ids) - words + 1
            if n <= 0:
                return
            frequent = x.frequent[ids]
            whole = frequent[:n].copy()
            packed = ids[:n].copy()
            for i in range(1, words):
                whole &= frequent[i : i + n]
                packed = (packed << BITS) | ids[i : i + n]
            packed, counts = np.unique(packed[whole], return_counts=True)
            if words > 2 and len(packed):
                own = hashes_of(x, packed)
                good = bloom.has(phrase_hash(x.key, own[:-1])) & bloom.has(phrase_hash(x.key, own[1:]))
                packed, counts = packed[good], counts[good]
            if len(packed):
                x.size += x.trie.add(packed, counts)

        def hashes_of(x: Language, packed: np.ndarray) -> list[np.ndarray]:
            return [x.hashes[(packed >> (BITS * (words - 1 - i))) & ((1 << BITS) - 1)] for i in range(words)]

        def run(x: Language, packed: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            """A sorted run, cut by prefix partition."""
            own = hashes_of(x, packed)
            prefix = np.where(np.isin(own[0], frequent), phrase_hash(1, own), phrase_hash(1, own[:1]))
            part = (prefix % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((*own[::-1], part))
            part, counts, own = part[order], counts[order], [h[order] for h in own]
            cuts = np.flatnonzero(np.diff(part)) + 1
            rows = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
                head = own[0][a:b]
                starts = np.concatenate([[0], np.flatnonzero(np.diff(head)) + 1])
                sizes = np.diff([*starts, b - a]).astype(np.uint32)
                rows.append((int(part[a]), head[starts].tobytes(), sizes.tobytes(), b"".join(h[a:b].tobytes() for h in own[1:]), counts[a:b].astype(np.uint32).tobytes()))
            for i in range(0, len(rows), 256):
                some = list(zip(*rows[i : i + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([x.lang] * len(some[0]), pa.string()), pa.array(some[0], pa.int32()), *[pa.array(c, pa.binary()) for c in some[1:]]], ["lang", "part", "heads", "sizes", "rest", "counts"])

        def spill(x: Language, least: int) -> Iterator[pa.RecordBatch]:
            packed, counts = x.trie.spill(least)
            x.size -= len(packed)
            if len(packed):
                yield from run(x, packed, counts)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = held.get(lang) or held.setdefault(lang, Language(lang))
                x.waiting += pieces(text.as_py())
                x.waiting.append(b"\n")
                if len(x.waiting) >= CHUNK:
                    count_waiting(x)
                    if len(x.numbers) > NUMBERED:  # numbers start anew
                        yield from spill(x, x.size)
                        x.anew()
                    while sum(y.size for y in held.values()) > HELD:
                        yield from spill(largest := max(held.values(), key=lambda y: y.size), largest.size // 2 + 1)
        for x in held.values():
            count_waiting(x)
            yield from spill(x, x.size)

    return count


def run_merger(words: int, least: int):
    """One prefix partition of a language: its runs, each of them sorted, merged and added up. Gives the
    phrases that occur ``least`` times or more."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        keys: list[list[np.ndarray]] = [[] for _ in range(words)]
        counts = []
        for heads, sizes, rest, n in zip(group["heads"], group["sizes"], group["rest"], group["counts"], strict=True):
            keys[0].append(np.repeat(np.frombuffer(heads, np.uint64), np.frombuffer(sizes, np.uint32)))
            for i, x in enumerate(np.frombuffer(rest, np.uint64).reshape(words - 1, -1), 1):
                keys[i].append(x)
            counts.append(np.frombuffer(n, np.uint32).astype(np.int64))
        own = [np.concatenate(k) for k in keys]
        order = np.lexsort(own[::-1])  # sorted runs are merged
        own = [k[order] for k in own]
        first = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in own], axis=0)]))
        sums = np.add.reduceat(np.concatenate(counts)[order], first)
        kept = sums >= least
        ids = np.stack([k[first][kept].view(np.int64) for k in own], axis=1) if kept.any() else np.empty((0, words), np.int64)
        return pd.DataFrame({"lang": pd.Series([group["lang"].iloc[0]] * len(ids), dtype=object), "ids": pd.Series(list(ids), dtype=object), "f": sums[kept]})

    return merge


def bloom_of(frequent: DataFrame) -> np.ndarray:
    """The filter of the phrases (lang, ids), of all lengths: bits are set in tasks, and their bytes, of fixed number, come
    to the driver."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for (lang, _), some in batch.groupby(["lang", batch["ids"].map(len)]):
                ids = np.stack(some["ids"].to_list()).astype(np.int64).view(np.uint64)
                h = phrase_hash(lang_number(lang), list(ids.T))
                found += [bloom_place(h, i) for i in range(BLOOM_HASHES)]
            at = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
            yield pd.DataFrame({"word": at >> 6, "bits": np.int64(1) << (at & 63)}, dtype="int64")

    words = frequent.select("lang", "ids").mapInPandas(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(2**BLOOM_BITS // 64, np.int64)
    table = words.toArrow()
    out[table["word"].to_numpy()] = table["bits"].to_numpy()
    return out.view(np.uint8)


def word_counts(texts: DataFrame, least: int, parts: int) -> tuple[DataFrame, DataFrame, int]:
    """Frequent words (lang, h, word, n), numbers of all words (lang, n), and the seed under which no hash
    stands for two words of a language."""
    for seed in range(42, 52):
        made = texts.mapInArrow(word_counter(seed, parts), "lang string, part int, hashes binary, checks binary, counts binary, words binary")
        words = stored(made.groupBy("lang", "part").applyInPandas(word_merger(least), "lang string, h long, word string, n long, clash boolean"), "words")
        if words.where("clash").isEmpty():
            totals = words.where("h IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
            return words.where("h IS NOT NULL").drop("clash"), stored(totals, "totals"), seed
    raise ValueError("no seed tells all words apart")


def phrase_counts(texts: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of frequent phrases (lang, ids, f), words (lang, h, word), and numbers of words (lang, n).

    ``texts`` is (lang, text) without null languages."""
    spark = texts.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, totals, seed = word_counts(texts, least, parts)
    shares = level.join(totals.withColumnRenamed("n", "_kv_all"), "lang").where(F.col("n") * HOT * parts > F.col("_kv_all"))
    hot = np.unique(np.array([r["h"] for r in shares.select("h").collect()], np.int64).view(np.uint64))  # at most HOT * parts a language
    named = level.select("lang", "h", "word")
    level = level.select("lang", F.array("h").alias("ids"), F.col("n").alias("f"))
    out = level
    sent_hot = spark.sparkContext.broadcast(hot)
    for k in range(2, longest + 1):
        sent = spark.sparkContext.broadcast(bloom_of(out))
        runs = texts.mapInArrow(phrase_counter(k, seed, sent, sent_hot, parts), "lang string, part int, heads binary, sizes binary, rest binary, counts binary")
        level = stored(runs.groupBy("lang", "part").applyInPandas(run_merger(k, least), "lang string, ids array<long>, f long"), f"phrases_{k}")
        out = out.unionByName(level)
    return out, named, totals


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = 10, contained: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` collocations.

    Texts are lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
    ``[^\\x20\\x09]+``. Phrases of 2 to ``longest`` (at most 3) words that occur ``least`` times or more are
    scored by their worst cut into two parts, floor(1000000 * a * a / (l * r)), in exact decimals for
    up to 10 ** 14 words a language. A phrase is dropped if a longer candidate with it inside has
    ``contained`` percent of its occurrences or more. Order: score, then a, both descending, then the
    phrase by bytes.

    A null text is empty; a null language is ``und``, as is one of that name. Rows are counted as often
    as they occur; ids aren't read, and other columns neither. Texts of any length are read whole.
    Without candidates there are no rows."""
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases have 2 to {LONGEST} words")
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    counts, named, totals = phrase_counts(texts, longest, least)
    phrases = counts.where(F.size("ids") > 1)
    cut = phrases.select("lang", "ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cut = cut.select("*", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("right"))
    one = counts.select("lang", F.col("ids").alias("left"), F.col("f").alias("l"))
    other = counts.select("lang", F.col("ids").alias("right"), F.col("f").alias("r"))
    met = cut.join(one, ["lang", "left"]).join(other, ["lang", "right"])
    score = F.expr("(CAST(a AS DECIMAL(14,0)) * CAST(a AS DECIMAL(14,0)) * CAST(1000000 AS DECIMAL(7,0))) div (CAST(l AS DECIMAL(14,0)) * CAST(r AS DECIMAL(14,0)))")
    scored = met.withColumn("score", score).groupBy("lang", "ids").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("x"))
    inner = phrases.where(F.size("ids") > 2).select("lang", "ids", "f")
    # All shorter phrases of two words or more within a longer one, each of its lengths and places.
    lengths = inner.select("*", F.explode(F.sequence(F.lit(2), F.size("ids") - 1)).alias("m"))
    within = lengths.select("lang", "f", F.explode(F.transform(F.sequence(F.lit(1), F.size("ids") - F.col("m") + 1), lambda i: F.slice("ids", i, F.col("m")))).alias("ids"))
    within = within.groupBy("lang", "ids").agg(F.max("f").alias("outer"))
    kept = scored.join(within, ["lang", "ids"], "left").where(F.col("outer").isNull() | (100 * F.col("outer") < contained * F.col("a")))
    kept = stored(kept.select("lang", "ids", "a", "x.score", "x.l", "x.r"), "kept")
    text = kept.select("lang", "ids", F.posexplode("ids").alias("place", "h")).join(named, ["lang", "h"]).groupBy("lang", "ids").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("w"))
    full = kept.join(text, ["lang", "ids"]).withColumn("phrase", F.array_join(F.col("w.word"), " "))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # Slices of a language keep their own first phrases, so that no task orders a whole language.
    few = full.withColumn("_kv_k", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))).where(F.col("_kv_k") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


ORACLE_OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, 1 AS k, unnest(w) AS g FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w WHERE len(w) > 2
), f AS (
  SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, g, f AS a, string_split(g, ' ') AS s FROM f WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT lang, k, g, a, unnest(range(1, k)) AS kk, s FROM c
), parts AS (
  SELECT lang, k, g, a, kk, array_to_string(s[1:kk], ' ') AS lg, array_to_string(s[kk + 1:k], ' ') AS rg FROM cuts
), scored AS (
  SELECT parts.lang, parts.g, parts.a, kk, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * parts.a * parts.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM parts JOIN f x ON x.lang = parts.lang AND x.g = lg AND x.k = kk JOIN f y ON y.lang = parts.lang AND y.g = rg AND y.k = parts.k - kk
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, kk) = 1
), inside AS (
  SELECT lang, unnest([array_to_string(s[1:2], ' '), array_to_string(s[2:3], ' ')]) AS g, a FROM c WHERE k = 3
), most AS (
  SELECT lang, g, max(a) AS outer_a FROM inside GROUP BY ALL
), kept AS (
  SELECT worst.* FROM worst LEFT JOIN most USING (lang, g) WHERE outer_a IS NULL OR 100 * outer_a < 50 * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept
)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
