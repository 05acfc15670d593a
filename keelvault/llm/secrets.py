"""Secret scans: patterns for well-known forms, and guess-cost analysis of values in a credential context.

The guess cost of a value is the logarithm (base 10) of the guesses that an attacker needs who
knows words, dates, repeats and keyboard walks. A dynamic program finds the cheapest segmentation of
the whole value, whatever its length: words come from an Aho-Corasick automaton, walks are states
that grow by a key at a time, and repeats are copies of what stands before them, so a repeated unit
costs what its own segmentation costs. Values whose cost reaches the threshold are reported as
spans of kind ``value``."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelvault.llm.common import documents, stored
from keelvault.llm.neardup import near

KINDS = ("assign", "access", "hex", "value")
#: Well-known weak words, most guessed first; ``corpus_words`` adds those of a corpus.
WEAK_WORDS = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login princess sunshine football "
    "iloveyou shadow superman secret test guest root changeme default user example sample demo access "
    "summer winter spring autumn hello love pass token key house happy money computer internet server "
    "database system service account public private company office mobile phone home work world"
).split()
#: Rows of keys, plain and shifted, each half a key to the right of the one above.
KEY_ROWS = (("`1234567890-=", "~!@#$%^&*()_+"), (" qwertyuiop[]\\", ' QWERTYUIOP{}|'), (" asdfghjkl;'", ' ASDFGHJKL:"'), (" zxcvbnm,./", " ZXCVBNM<>?"))
#: Costs (log10 of guesses): where a walk starts, a turn into one of six directions, one more key in
#: the direction, a change of the shift key; and that the attacker doesn't know where segments meet.
WALK_START, WALK_TURN, WALK_ON, WALK_SHIFT, JOIN = math.log10(47), math.log10(6), 0.05, math.log10(2), 0.3
#: log10 of guesses from which a value in a credential context is a secret.
THRESHOLD = 8.0
#: Share of the distinct texts that hold a word of the corpus.
WORD_SHARE = 0.001

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("cost", T.DoubleType())]))
FOUND = T.StructType(
    [
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("found", SPANS),
    ]
)
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())])
_FOUND = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("found", pa.list_(_SPAN))])

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: More names of credentials, more ways to give a value, and values of any visible characters: what
#: opens with a quote goes to the same quote on the line (group 2), all else to white space (group 4).
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|private[_-]?key|access[_-]?key|auth(?:orization)?)["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*(?:bearer[\x20\t]+)?+"""
    r"""(?:(["'`])((?:(?!\1)[^\r\n]){6,}+)\1|(?!(["'`])(?:(?!\3)[^\r\n])*+\3)["'`]?+(\S{6,}))""",
    re.IGNORECASE | re.ASCII,
)
#: A credential's name with its separator and the rest of the line, which holds every value of ASSIGN and CONTEXT.
CONTEXT_LINE = r"""(?i)(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|private[_-]?key|access[_-]?key|auth(?:orization)?)["']?[\x20\t]*(?::=|=>|[:=])[^\r\n]*"""
YEAR = re.compile(r"(?:19|20)\d\d")
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d)", re.ASCII)
LEET = str.maketrans("4@301!$5+7", "aaeoilsstt")


def word_ranks(words) -> dict[str, float]:
    """Guesses that find each word: its place in a list, or what a mapping says."""
    ranks: dict[str, float] = {}
    for w, rank in words.items() if isinstance(words, Mapping) else ((w, i + 1) for i, w in enumerate(words)):
        ranks[w.lower()] = min(rank, ranks.get(w.lower(), math.inf))
    return ranks


def outside_contexts(text: Column) -> Column:
    """A text without what follows a credential's name on its line, whatever it is."""
    return F.regexp_replace(text, CONTEXT_LINE, " ")


def corpus_words(docs: DataFrame, share: float = WORD_SHARE) -> dict[str, float]:
    """{word: guesses}: the weak words by place, and the words of ``docs`` by frequency.

    Words of a corpus are 2 to 32 letters between white space or the punctuation of prose, in lower
    case. They are counted over distinct texts, so copies of a text count once, and outside of
    credential contexts, so no value is priced by itself. Those in at least ``share`` of the distinct
    texts are taken to the driver: as many as distinct words of a text on average, divided by the
    share, at most, whatever the number of documents. A word is guessed after as many tries as the
    reciprocal of its share of all that are taken. Null texts have no words."""
    pattern = r"(?<![^\s\"'(\[])\p{L}{2,32}+(?![^\s.,;:!?\"')\]])"
    texts = docs.where("text IS NOT NULL").select(F.sha2("text", 256).alias("d"), "text")
    digests = stored(texts.groupBy("d").agg(F.count("*").alias("k")), "digests")
    repeated = near(stored(digests.where("k > 1").select(F.col("d").alias("_kv_d")), "repeated"))
    same = F.col("d") == F.col("_kv_d")
    once = texts.join(repeated, same, "left_anti").unionByName(texts.join(repeated, same, "left_semi").dropDuplicates(["d"]))
    each = once.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(outside_contexts(F.col("text"))), F.lit(pattern), F.lit(0)))).alias("word"))
    least = share * digests.count()
    kept = {r["word"]: r["n"] for r in each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()}
    total = sum(kept.values())
    ranks = word_ranks(WEAK_WORDS)
    return {**{w: total / n for w, n in kept.items()}, **{w: min(rank, total / kept[w]) if w in kept else rank for w, rank in ranks.items()}}


def character_cost(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.islower() else math.log10(52) if c.isalpha() else math.log10(95)


def word_cost(part: str, rank: int, plain: bool) -> float:
    """Cost of a word of a rank, by the case of its letters and whether letters are written as signs."""
    low = part.lower()
    shapes = 1 if part == low else 2 if part in (low.capitalize(), low.upper()) else 2 ** min(sum(map(str.isupper, part)), 10)
    return math.log10(rank * shapes * (1 if plain else 4) + 1)


def key_places() -> dict[str, tuple[int, int, bool]]:
    """Of each key's characters: row, place, shifted."""
    return {c: (y, x, shifted) for y, rows in enumerate(KEY_ROWS) for shifted, row in enumerate(rows) for x, c in enumerate(row) if c != " "}


PLACES = key_places()
#: From a key to its neighbours, by (rows down, keys right); each row stands half a key to the right.
DIRECTIONS = {(0, -1): 0, (0, 1): 1, (-1, 0): 2, (-1, 1): 3, (1, -1): 4, (1, 0): 5}


def walk_steps(one: str, other: str) -> list[tuple[int, float]]:
    """The directions that lead from a character to the next: between neighbouring keys (0 to 5), and
    forwards and backwards in the alphabet (6 and 7), each with what a change of the shift key costs."""
    steps = []
    if one.isascii() and one.isalpha() and other.isascii() and other.isalpha() and abs(ord(one) - ord(other)) == 1:
        steps.append((6 if one < other else 7, 0.0))
    a, b = PLACES.get(one), PLACES.get(other)
    if a and b and (d := DIRECTIONS.get((b[0] - a[0], b[1] - a[1]))) is not None:
        steps.append((d, WALK_SHIFT if a[2] != b[2] else 0.0))
    return steps


def repetitions(s: str) -> list[tuple[int, int, int]]:
    """(start, end, period) of all maximal repetitions: spans of at least two periods, of the smallest
    period that they have.

    A repetition of period p holds an index one below a multiple of p, so only those are looked at;
    spans that a smaller period explains are skipped as a whole."""
    n, found = len(s), []
    long: list[tuple[int, int, int]] = []  # those that may explain spans of the period at hand
    for p in range(1, n // 2 + 1):
        known = None
        long = [r for r in long if r[1] - r[0] > p] if long else long
        at = p - 1
        while at < n - p:
            if s[at] != s[at + p]:
                at += p
                continue
            if known is None:
                known = sorted(r for r in long if p % r[2] == 0)
            k = bisect_right(known, (at, n + 1, 0)) - 1
            cover = max((e for b, e, _ in known[max(0, k - 8) : k + 1] if b <= at and at + p < e), default=0)
            if cover:
                at += max(1, (cover - p - at + p - 1) // p) * p
                continue
            left, right = at, at + 1
            while left > 0 and s[left - 1] == s[left - 1 + p]:
                left -= 1
            while right < n - p and s[right] == s[right + p]:
                right += 1
            if right - left >= p:
                found.append((left, right + p, p))
                long.append(found[-1])
            at += max(1, (right - at + p - 1) // p) * p
    return found


class Guesser:
    """Guess costs under a ranked list of words."""

    def __init__(self, words):
        import ahocorasick

        self.ranks = word_ranks(words)
        self.words = ahocorasick.Automaton()
        for w, rank in self.ranks.items():
            self.words.add_word(w, (len(w), rank))
        if len(self.words):
            self.words.make_automaton()

    def segments(self, value: str) -> list[list[tuple[int, float]]]:
        """By end: (start, cost) of all words and dates in ``value``."""
        ends: list[list[tuple[int, float]]] = [[] for _ in range(len(value) + 1)]
        low = "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in value))
        if len(self.words):
            for form, plain in ((low, True), (low.translate(LEET), False)):
                if plain or form != low:
                    for last, (n, rank) in self.words.iter(form):
                        start = last + 1 - n
                        ends[last + 1].append((start, word_cost(value[start : last + 1], rank, plain)))
        for i, c in enumerate(value):
            if "0" <= c <= "9":
                for n in range(4, 11):
                    part = value[i : i + n]
                    if len(part) == n:
                        if n == 4 and YEAR.fullmatch(part):
                            ends[i + n].append((i, 2.0))
                        if n >= 6 and DATE.fullmatch(part):
                            ends[i + n].append((i, math.log10(365 * 120 * (1 if part.isdigit() else 4))))
        return ends

    def cost(self, value: str) -> float:
        """Cost of the cheapest segmentation of ``value`` into words, dates, walks, copies of what
        stands before, and single characters by brute force.

        m copies of a unit, the smallest one, cost log10(m + 1). Copies that start where a copy of the same repetition has ended
        are never cheaper than one longer copy, so each repetition has few starts to try."""
        ends = self.segments(value)
        opens: dict[int, list[tuple[int, int]]] = {}
        for start, end, p in repetitions(value):
            opens.setdefault(start + p, []).append((end, p))
        cost = [0.0]
        walks: dict[int, float] = {}
        active: list[tuple[int, int, dict[int, list[tuple[int, float]]]]] = []
        for e in range(1, len(value) + 1):
            best = cost[e - 1] + character_cost(value[e - 1])
            for start, c in ends[e]:
                best = min(best, cost[start] + c + JOIN)
            if e > 1:
                turned = min([cost[e - 2] + JOIN + WALK_START, *walks.values()]) + WALK_TURN
                walks = {d: min(walks.get(d, math.inf) + WALK_ON, turned) + shift for d, shift in walk_steps(value[e - 2], value[e - 1])}
                best = min([best, *walks.values()])
            if e in opens:
                active += [(end, p, {}) for end, p in opens[e]]
            if active:
                active = [x for x in active if e <= x[0]]
                copied = [min((c + math.log10((e - x) // p + 1) + JOIN for x, c in sources.get(e % p, ())), default=math.inf) for _, p, sources in active]
                best = min(best, *copied) if copied else best
                for (_, p, sources), c in zip(active, copied, strict=True):
                    if best < c - 1e-12 or c == math.inf:  # not reached by copies of this repetition
                        kept = [(x, y) for x, y in sources.get(e % p, ()) if y < best]
                        sources[e % p] = [*kept, (e, best)]
            cost.append(best)
        return cost[-1]


_GUESSERS: dict[str, Guesser] = {}


def guesser(key: str, words) -> Guesser:
    """A guesser that a Python worker makes once, whatever number of tasks it runs."""
    if key not in _GUESSERS:
        _GUESSERS.clear()
        _GUESSERS[key] = Guesser(words)
    return _GUESSERS[key]


def guess_cost(value: str, words=tuple(WEAK_WORDS)) -> float:
    """Cost of one value under ``words``, the most guessed first."""
    return Guesser(words).cost(value)


#: What matches of ASSIGN and CONTEXT start with, in lower case.
ASSIGN_STARTS = (b"password", b"passwd", b"secret", b"token", b"api")
CONTEXT_STARTS = (b"pass", b"pwd", b"secret", b"token", b"api", b"credential", b"private", b"access", b"auth")
_HEX_BYTES = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))


def matches(pattern: re.Pattern, starts: tuple[bytes, ...], text: str, low: bytes) -> Iterator[re.Match]:
    """What ``pattern.finditer(text)`` gives, tried only where one of ``starts`` stands in ``low``
    (the text's UTF-8 bytes with A-Z in lower case), since plain searches are much faster."""
    places = set()
    for s in starts:
        at = low.find(s)
        while at >= 0:
            places.add(at)
            at = low.find(s, at + 1)
    byte, char, end = 0, 0, 0
    for at in sorted(places):
        char += len(low[byte:at].decode("utf-8", "surrogatepass"))
        byte = at
        if char >= end and (m := pattern.match(text, char)):
            yield m
            end = m.end()


def find_spans(text: str, guess: Guesser, threshold: float) -> list[tuple[str, int, int, float]]:
    """All spans of a text as (kind, start, end, cost), by start, then kind in the order of KINDS."""
    spans = []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    for m in matches(ASSIGN, ASSIGN_STARTS, text, low):
        if len(m[2]) >= 6:
            spans.append(("assign", *m.span(), guess.cost(m[2])))
    if b"AKIA" in raw:
        spans += [("access", *m.span(), guess.cost(m[0])) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in raw.translate(_HEX_BYTES):
        spans += [("hex", *m.span(), guess.cost(m[0])) for m in HEX.finditer(text)]
    for m in matches(CONTEXT, CONTEXT_STARTS, text, low):
        group = 2 if m[1] else 4
        cost = guess.cost(m[group])
        if cost >= threshold:
            spans.append(("value", *m.span(group), cost))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def scanner(key: str, sent, threshold: float):
    """text -> FOUND as a column function; null is the empty text. ``sent`` holds the words, broadcast."""

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        guess = guesser(key, sent.value)
        for batch in batches:
            out = []
            for value in batch:
                spans = find_spans(value.as_py() or "", guess, threshold)
                told = [(k, f"{k}:{a}:{b}") for k, a, b, _ in spans]
                base = ",".join(x for k, x in told if k != "value")
                counts = {f"n_{k}": sum(x[0] == k for x in spans) for k in KINDS[:3]}
                out.append(counts | {"base_sha256": hashlib.sha256(base.encode()).hexdigest(), "spans": ",".join(x for _, x in told), "found": [dict(zip(("kind", "start", "end", "cost"), x, strict=True)) for x in spans]})
            yield pa.array(out, _FOUND)

    return F.arrow_udf(scan, FOUND).asNondeterministic()


def scan_secrets(docs: DataFrame, words=tuple(WEAK_WORDS), threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``secrets``: counts of the base kinds, a digest of the base spans, all spans as
    text, and ``found`` (kind, start, end in code points, end exclusive, guess cost).

    Base spans are always reported, with the guess cost of the value; the cost decides which values
    in a wider credential context are added. A null text is empty and has no spans; texts and values
    of any length are read whole. Rows are independent, so equal rows have equal results; a column
    secrets is replaced; an empty table gives an empty table. ``words``, the most
    guessed first or with their guesses, are broadcast."""
    words = word_ranks(words)
    key = hashlib.sha256(repr(sorted(words.items())).encode()).hexdigest()
    return docs.withColumn("secrets", scanner(key, docs.sparkSession.sparkContext.broadcast(words), threshold)("text"))


def coverer(mark: str):
    """(text, found spans) -> text with ``mark`` for every span, as a column function."""

    def cover(text: str | None, spans: list[dict] | None) -> str | None:
        if not text or not spans:
            return text
        out, at = [], 0
        for s in sorted(spans, key=lambda s: s["start"]):
            if s["start"] >= at:
                out += [text[at : s["start"]], mark]
            at = max(at, s["end"])
        return "".join([*out, text[at:]])

    def column(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            yield pa.array([cover(t.as_py(), s.as_py()) for t, s in zip(texts, spans, strict=True)], pa.string())

    return F.arrow_udf(column, "string").asNondeterministic()


def redact(docs: DataFrame, mark: str = "[secret]", words=tuple(WEAK_WORDS)) -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans are replaced as one.

    Null texts stay null, other columns stay as they are, also one named secrets."""
    own = "secrets" in docs.columns
    plain = docs.withColumnRenamed("secrets", "_kv_secrets") if own else docs
    out = scan_secrets(plain, words).withColumn("text", coverer(mark)("text", "secrets.found")).drop("secrets")
    return out.withColumnRenamed("_kv_secrets", "secrets") if own else out


def op3_guess_cost_secrets(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    s = scan_secrets(docs, corpus_words(docs))
    return s.select("doc_id", *[f"secrets.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])
