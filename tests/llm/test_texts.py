"""Languages, secrets, near-duplicates, toxicity, tokens, archives and decontamination."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF, same_as_sql

from keelvault.llm import decontaminate, language, neardup, registry, secrets, tokens, toxicity, warc
from keelvault.llm.common import shared_folder

SF01 = "/root/testdata/sf0.01"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, scan string")


# Languages


def test_language_held_out(spark):
    got = language.op2_language_spans(spark, SF01).join(spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    test = got[got.held_out]
    assert (test.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in test.doc_id]).all() and len(test) > 100
    assert (test.lang == test.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_spans(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = language.fit(docs, docs.lang)
    one = {r.lang: r.text for r in docs.where("n_chars > 3000 AND doc_id < 100").collect()}
    mixed = one["en"][:300] + " " + one["de"][:300] + " " + one["en"][300:500]
    texts = [None, "", "12 3! \u0301 \u0301\u0302", mixed, one["fr"] * 3, "ж", "\U0001d400"]
    got = {r.doc_id: r.language for r in language.identify(frame(spark, texts).withColumnRenamed("scan", "language"), model).collect()}
    assert [got[i].lang for i in range(3)] == ["und"] * 3 and got[0].score == 0
    assert [s.lang for s in got[3].spans] == ["en", "de", "en"] and abs(got[3].spans[0].end - 300) < 25
    assert got[4].lang == "fr" and got[5].lang in model["langs"] and got[6].lang in model["langs"]
    empty = language.fit(docs.limit(0), docs.lang)
    assert language.identify(frame(spark, ["abc"]), empty).first().language.lang == "und"


def test_language_learns_from_whole_texts(spark):
    """What tells two languages apart lies behind the first 6,000 characters of their texts."""
    rows = [(i, "x " * 4000 + ("krotz plimf " if i % 2 else "babila onoro ") * 200, "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, docs.lang)
    got = [r.language.lang for r in language.identify(frame(spark, ["plimf krotz", "onoro babila"]), model).orderBy("doc_id").collect()]
    assert got == ["b", "a"]


def test_language_sample_is_bounded(spark):
    """Equal rows count once, rows without text or label teach nothing, and null ids are like others."""
    rows = [(1, "lorem ipsum", "a")] * 3000 + [(None, "dolor sit", "a"), (2, None, "a"), (3, "amet", None), (4, "quux", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, docs.lang)
    one = language.fit(docs.distinct(), docs.lang)
    assert model["langs"] == ["a", "b"] and np.array_equal(model["weights"], one["weights"])


def test_many_languages(spark):
    rng = random.Random(5)
    words = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(20)] for i in range(300)}
    docs = spark.createDataFrame([(i, " ".join(w), k) for i, (k, w) in enumerate(words.items(), 1) for _ in "ab"], "doc_id long, text string, lang string")
    docs = docs.where(~language.held_out(docs.doc_id))
    model = language.fit(docs, docs.lang)
    assert len(model["langs"]) > 200
    got = language.identify(docs, model).select("lang", "language.lang").collect()
    assert all(a == b for a, b in got)


def plain_language(text, model, switch=language.SWITCH):
    """One text, word by word and run by run, without arrays."""
    import unicodedata

    scripts = {c: language.NAMES.index(n) for n, a, b in language.SCRIPTS for c in range(a, b + 1)}
    low = [(c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LM" else None for c in text]
    words, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and low[j] is not None:
            j += 1
        if any(unicodedata.category(c)[0] == "L" for c in text[i:j]):
            words.append((i, j))
        i = max(j, i + 1)
    k = len(model["langs"])
    rows = []
    for a, b in words:
        chars = [1, *(ord(c) for c in low[a:b]), 1]
        score = np.zeros(k)
        for n in language.GRAMS:
            for x in range(len(chars) - n + 1):
                h = n
                for c in chars[x : x + n]:
                    h = ((h ^ (h >> 15)) * 0x2C1B3C6D + c) % 2**32
                score += model["weights"][((h ^ (h >> 16)) * 0x297A2D39 % 2**32) >> 16]
        score /= len(language.GRAMS)
        can = model["uses"][scripts.get(ord(low[a]), 0)]
        rows.append(score - 30 * (~can if can.any() else np.zeros(k)))
    if not rows:
        return "und", 0.0, []
    best, back = rows[0], []
    for r in rows[1:]:
        step = [max(range(k), key=lambda p, q=q: (best[p] - (switch if p != q else 0), p == q)) for q in range(k)]
        back.append(step)
        best = np.array([best[p] - (switch if p != q else 0) for q, p in enumerate(step)]) + r
    path = [int(np.argmax(best))]
    for step in reversed(back):
        path.append(step[path[-1]])
    path.reverse()
    share, spans = np.zeros(k), []
    for (a, b), p in zip(words, path, strict=True):
        share[p] += b - a
        if spans and spans[-1][2] == model["langs"][p]:
            spans[-1] = (spans[-1][0], b, spans[-1][2])
        else:
            spans.append((a, b, model["langs"][p]))
    return model["langs"][int(share.argmax())], share.max() / share.sum(), spans


def test_language_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = language.fit(docs, docs.lang)
    some = [r.text for r in docs.where("n_chars < 900").orderBy("doc_id").collect()]
    texts = [some[i] + " " + some[i + 1] for i in range(0, 60, 2)] + some[60:90] + ["\u0441\u043b\u043e\u0432\u043e word \u0441\u043b\u043e\u0432\u043e", "\u00c9 e\u0301 \u0130x", None]
    for r in language.identify(frame(spark, texts), model).collect():
        name, score, spans = plain_language(r.text or "", model)
        assert r.language.lang == name and abs(r.language.score - score) < 1e-9
        assert [tuple(x) for x in r.language.spans] == spans


def test_viterbi_is_optimal():
    rng = np.random.default_rng(3)
    lengths = np.array([0, 7, 1, 5])
    scores = rng.normal(0, 2, (13, 3)).astype(np.float32)
    path = language.viterbi(scores, np.cumsum(lengths) - lengths, lengths, 1.5)
    import itertools

    at = 0
    for n in lengths:
        def value(p, at=at, n=n):
            return sum(scores[at + i, p[i]] for i in range(n)) - 1.5 * sum(p[i] != p[i - 1] for i in range(1, n))
        if n:
            assert abs(value(path[at : at + n]) - max(map(value, itertools.product(range(3), repeat=int(n))))) < 1e-4
        at += n


# Secrets


def test_secrets_against_plain_patterns(spark):
    texts = [None, "", "password = hunter22 Token:abc", "API_KEY='AbC-1234567/+=' ſecret=abcdefgh", "é" * 50 + " secret: 0123456789abcdef0123456789abcdef AKIA" + "Z" * 16, "AKIAABC", "f" * 23, "tokentoken=123456 passwd => x9#Lq!2vTz", "passwordpassword=" + "a" * 5000]
    texts += [t for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for r in secrets.scan_secrets(frame(spark, texts)).collect():
        t = r.text or ""
        want = [("assign", *m.span()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 6]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
        want.sort(key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.secrets.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        spans = r.secrets.spans.split(",") if r.secrets.spans else []
        assert ",".join(s for s in spans if not s.startswith("value")) == told
        assert (r.secrets.n_assign, r.secrets.n_access, r.secrets.n_hex) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))


def plain_cost(value, words):
    """The cheapest of all segmentations: every span is tried as everything that it can be."""
    import math

    ranks = {}
    for i, w in enumerate(words):
        ranks.setdefault(w, i + 1)
    leet = dict(zip("4@301!$5+7", "aaeoilsstt", strict=True))
    rows = [("`1234567890-=", "~!@#$%^&*()_+"), (" qwertyuiop[]\\", " QWERTYUIOP{}|"), (" asdfghjkl;'", ' ASDFGHJKL:"'), (" zxcvbnm,./", " ZXCVBNM<>?")]
    place = {c: (y, x, k) for y, pair in enumerate(rows) for k, row in enumerate(pair) for x, c in enumerate(row) if c != " "}
    near = {(0, -1), (0, 1), (-1, 0), (-1, 1), (1, -1), (1, 0)}

    def single(c):
        return 1.0 if c.isdigit() else math.log10(26) if c.islower() else math.log10(52) if c.isupper() else math.log10(95)

    def walk(part):
        if len(part) < 2:
            return math.inf
        ways = {None: math.log10(47)}
        for p, q in zip(part, part[1:], strict=False):
            new = {}
            options = []
            if p in place and q in place and (place[q][0] - place[p][0], place[q][1] - place[p][1]) in near:
                options.append(((place[q][0] - place[p][0], place[q][1] - place[p][1]), math.log10(2) if place[p][2] != place[q][2] else 0))
            if p.isalpha() and q.isalpha() and p.isascii() and q.isascii() and abs(ord(p) - ord(q)) == 1:
                options.append((ord(q) - ord(p), 0))
            for d, shift in options:
                new[d] = min(min(ways.values()) + math.log10(6), ways.get(d, math.inf) + 0.05) + shift
            ways = new
            if not ways:
                return math.inf
        return min(ways.values())

    def word(part):
        low = part.lower()
        best = math.inf
        for form, factor in ((low, 1), ("".join(leet.get(c, c) for c in low), 4)):
            if form in ranks and (factor == 1 or form != low):
                upper = sum(c.isupper() for c in part)
                shapes = 1 if part == low else 2 if part in (low.capitalize(), low.upper()) else 2 ** min(upper, 10)
                best = min(best, math.log10(ranks[form] * shapes * factor + 1))
        return best

    def date(part):
        if re.fullmatch(r"(19|20)\d\d", part):
            return 2.0
        if secrets.DATE.fullmatch(part) and 6 <= len(part) <= 10:
            return math.log10(365 * 120 * (1 if part.isdigit() else 4))
        return math.inf

    cost = [0.0]
    for e in range(1, len(value) + 1):
        options = [cost[e - 1] + single(value[e - 1])]
        for b in range(e):
            part = value[b:e]
            options += [cost[b] + 0.3 + f(part) for f in (walk, word, date)]
            for p in range(1, min(b, e - b) + 1):
                unit = value[b - p : b]
                smallest = not any(p % q == 0 and unit == unit[:q] * (p // q) for q in range(1, p))
                if smallest and (e - b) % p == 0 and part == unit * ((e - b) // p):
                    options.append(cost[b] + 0.3 + math.log10((e - b) // p + 1))
        cost.append(min(options))
    return cost[-1]


def test_guess_costs():
    guess = secrets.Guesser(secrets.WEAK_WORDS)
    cost = guess.cost
    assert all(cost(v) < 6 for v in ("password", "P4ssw0rd2019", "qwertyuiop", "aaaaaaaaaaaa", "2024-01-31", "dragon1999", "1qaz2wsx", "zaq12wsx", "abcdefgh", "a" * 500, "x" * 100, "ab" * 40))
    assert all(cost(v) > 10 for v in ("x9#Lq!2vTz", "24be64439e3e49cf46b2"))
    assert cost("x9#Lq!2vTz" * 10**3) < cost("x9#Lq!2vTz") + 3.4 and cost("a" * 10**5) < 7
    # The dynamic program against all segmentations.
    rng = random.Random(2)
    values = ["pass1999aaa", "Dragon2024-01-31x", "zaq12wsx!", "qwertYUIop", "abababpassabab", "P@ssW0rd11", "aAbBcCaAbBcC", "\u00c9tudepass", "1" * 9 + "2", ""]
    values += ["".join(rng.choice("abpsword1209qaz!A") for _ in range(rng.randint(1, 14))) for _ in range(150)]
    values += ["".join(rng.choice("ab") for _ in range(rng.randint(2, 16))) for _ in range(100)]
    values += [rng.choice(secrets.WEAK_WORDS).capitalize() + rng.choice(["", "qwe", "2020", "!!", "xyz"]) * rng.randint(1, 3) for _ in range(50)]
    for v in values:
        assert abs(cost(v) - plain_cost(v, secrets.WEAK_WORDS)) < 1e-9, v
    assert secrets.Guesser(()).cost("abc") < 5


def test_value_spans_against_plain_patterns(spark):
    """Every match of the pattern, found by plain search, with the plain cost."""
    texts = ["pwd = x9#Lq!2vTz, auth: 'qwerty12' token => \"aB3$kk9!\"", "PassPhrase := dragon1999dragon passcode=7hG:2", "credentials = " + "z" * 60, None, ""]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    words = secrets.WEAK_WORDS
    for r in secrets.scan_secrets(frame(spark, texts), words).collect():
        want = []
        for m in secrets.CONTEXT.finditer(r.text or ""):
            group = 2 if m[1] else 4
            if plain_cost(m[group], words) >= secrets.THRESHOLD:
                want.append(f"value:{m.start(group)}:{m.end(group)}")
        assert [x for x in r.secrets.spans.split(",") if x.startswith("value")] == want


def test_redact(spark):
    out = secrets.redact(frame(spark, ["my token = abcdef123 ok", None, "pwd: x9#Lq!2vTz!"])).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["my [secret] ok", None, "pwd: [secret]"]


def test_secrets_aligned_and_punctuated():
    guess = secrets.Guesser(secrets.WEAK_WORDS)

    def values(t):
        return [t[a:b] for k, a, b, _ in secrets.find_spans(t, guess, secrets.THRESHOLD) if k == "value"]

    assert values("private_key          =        x9#Lq!2vTz\npwd\t\t\t\t\t\t: 'k8 (w,2;qT' # x") == ["x9#Lq!2vTz", "k8 (w,2;qT"]
    assert values('pwd = "Xk9(v,2;qT" and more') == ["Xk9(v,2;qT"] and values("pwd=Xk9(v,2;qT{}<> z") == ["Xk9(v,2;qT{}<>"]
    assert values('pwd = "ab", user = "x9#Lq!2vTz"') == [] and values('pwd = "x9#Lq!2vTz\nnext" line') == ["x9#Lq!2vTz"]
    assert values("auth: bearer   x9#Lq!2vTz") == ["x9#Lq!2vTz"] and values("auth: bearer ab") == []


def test_secrets_ordinary_words(spark, tmp_path):
    """Words of the corpus are no secrets as values; random letters are."""
    texts = [f"It is required here, everything else is (optional), {i}.\nThe password: required, my auth: everything and pwd: required here" for i in range(6)] + ["pwd: zqvkxwjhgb"]
    frame(spark, texts).drop("scan").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.spans for r in secrets.op3_guess_cost_secrets(spark, str(tmp_path)).collect()}
    assert all("value" not in got[i] and got[i].startswith("assign") for i in range(6)) and got[6] == "value:5:15"
    words = secrets.corpus_words(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert {"required", "everything", "optional"} <= set(words) and "zqvkxwjhgb" not in words
    few = spark.createDataFrame([(t,) for t in ["alpha beta"] * 6 + ["alpha", None, "pwd = gamma delta\nalpha beta x"]], "text string")
    new = [{w: r for w, r in secrets.corpus_words(few, share).items() if w not in secrets.WEAK_WORDS} for share in (0.7, 0.5)]
    assert new == [{"alpha": 1.0}, {"alpha": 5 / 3, "beta": 5 / 2}]


@pytest.mark.parametrize("copies", [1, 5, 1000])
def test_copies_do_not_hide_secrets(spark, copies):
    """A value is found whatever the number of documents that leak it, with equal texts or different ones."""
    values = ["correcthorsebatterystaple", "kjhqwezxcmnb", "k8w2qTz9LmP4"]
    prose = [f"The battery of the horse is correct here {i}" for i in range(20)]
    texts = [f"pwd = {v}" for v in values for _ in range(copies)] + [f"note {i}\nauth: {v}" for v in values for i in range(copies)]
    docs = frame(spark, texts + prose)
    got = secrets.scan_secrets(docs, secrets.corpus_words(docs)).select("text", "secrets.spans").collect()
    for r in got[: len(texts)]:
        start = max(r.text.find("= "), r.text.find(": ")) + 2
        assert r.spans == f"value:{start}:{len(r.text)}"
    assert all(r.spans == "" for r in got[len(texts) :])


# Near-duplicates


def shingles(t, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    return {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def plain_components(rows, width):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(rows[i][0], len(sets[i]), rows[root(i)][0], root(i) == i) for i in range(len(rows))]


def drifting(n=260, seed=1):
    """Groups of copies with different numbers of edits, chains, equal texts, short and empty ones."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocab) for _ in range(40)]
    rows = []
    for i in range(n):
        w = list(base) if i % 3 else [rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 8]))]
        if i > n // 2 and i % 3 == 2:
            w = rows[i - 3][1].split() or w
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            if len(w) > 1:
                w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w).replace("w1", "W1")))
    return [*rows, (n, None), (n + 1, " \n"), (n + 2, "É é"), (n + 3, "é É")]


@pytest.mark.parametrize("large,block", [(64, 512), (3, 7)])
def test_near_duplicates(spark, monkeypatch, large, block):
    monkeypatch.setattr(neardup, "LARGE", large)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = drifting()
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, node long, component_id long")
    assert sorted(map(tuple, neardup.near_duplicates(df, 2, 80).collect())) == sorted(plain_components(rows, 2))


def test_near_duplicates_odd_tables(spark):
    schema = "doc_id long, text string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (9, None)]
    got = sorted((tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (5, 2, 1, False), (9, 0, 9, True)], key=str)
    kept = neardup.deduplicate(spark.createDataFrame(rows, schema)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "1", "9", "None"]


def test_near_duplicates_repeated_ids(spark):
    """Rows of one id are one document, whatever texts they have; copies in any number are one class."""
    text = " ".join(f"w{i}" for i in range(60))
    other, third = text.replace("w30", "v30"), " ".join(f"u{i}" for i in range(30))
    rows = [(1, text), (5, text), (5, third), (7, third), (8, other), (9, "alone")] + [(i, text) for i in range(100, 400)] + [(50, "x y z")] * 400
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 70).collect()}
    assert {got[i] for i in (1, 5, 7, 8, 100, 399)} == {1} and got[9] == 9 and got[50] == 50
    two = [(1, "a b c"), (2, "d e f"), (3, "a b c"), (3, "d e f")]
    assert {r.component_id for r in neardup.near_duplicates(spark.createDataFrame(two, "doc_id long, text string")).collect()} == {1}


def test_estimate_is_unbiased(spark):
    from pyspark.sql import functions as F

    words = [f"x{i}" for i in range(400)]
    pairs = [(" ".join(words[:300]), " ".join(words[k : 300 + k])) for k in range(0, 60, 2)]
    sk = neardup.sketcher(1)
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sk("a").alias("x"), sk("b").alias("y"))
    for r in df.select("a", "b", neardup.estimate(F.col("x.sig"), F.col("y.sig")).alias("e")).collect():
        a, b = set(r.a.split()), set(r.b.split())
        assert abs(r.e - len(a & b) / len(a | b)) < 0.12


# Toxicity


def test_network_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.start_parameters(np.zeros(toxicity.WORD_BUCKETS + toxicity.CHAR_BUCKETS)).items()}
    words = [f"w{i}".encode() for i in range(9)]
    windows = [rng.integers(0, 9, n) for n in (5, 32, 1)]
    index, mask = toxicity.pack(windows)
    proj = {d: rng.normal(0, 1, (9, 3 * toxicity.HIDDEN)) for d in "fb"}
    logit, saved = toxicity.forward(p, index, proj, mask, keep=True)
    d_logit = rng.normal(0, 1, 3)
    g, d_gates = toxicity.backward(p, d_logit, index, mask, saved)
    for name in ("Uf", "Ub", "A", "V", "O"):
        at = tuple(int(rng.integers(n)) for n in p[name].shape)
        old, step = p[name][at], 1e-3
        p[name][at] = old + step
        up = toxicity.forward(p, index, proj, mask)[0] @ d_logit
        p[name][at] = old - step
        down = toxicity.forward(p, index, proj, mask)[0] @ d_logit
        p[name][at] = old
        assert abs((up - down) / (2 * step) - g[name].reshape(p[name].shape)[at]) < 2e-3
    halved = {d: (np.concatenate([proj[d][:, : 2 * toxicity.HIDDEN] * 0.5, proj[d][:, 2 * toxicity.HIDDEN :]], axis=1)).astype(np.float32) for d in "fb"}
    assert np.allclose(toxicity.logits({k: v.astype(np.float32) for k, v in p.items()}, index, halved, mask), logit, atol=1e-3)
    assert len(words) == 9 and d_gates["f"].shape == (32, 3, 3 * toxicity.HIDDEN)


def test_windows_cover_every_word():
    for n in (1, 31, 32, 33, 47, 48, 49, 1000):
        assert set().union(*(range(a, b) for a, b in toxicity.cut(n))) == set(range(n))


def test_toxicity_held_out(spark):
    got = toxicity.op6_toxicity_gru(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").toPandas()
    test = got[got.held_out]
    y, s = test.toxic.to_numpy(), test.score.rank().to_numpy()
    auc = (s[y == 1].mean() - (y == 1).sum() / 2 - 0.5) / (y == 0).sum()
    assert auc > 0.92 and got.score.between(0, 1).all()
    assert test[test.toxic == 1].predicted.mean() > 0.75 and test[test.toxic == 0].predicted.mean() < 0.05


def test_toxicity_learns_from_whole_texts(spark):
    """What tells toxic texts apart lies behind their first 6,000 characters."""
    rows = [(i, "fine words " * 600 + ("you idiot " if i % 2 else "good people ") * 5, i % 2) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    p = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = toxicity.score_toxicity(df, p).collect()
    assert all((r.toxicity.score >= 0.5) == (r.toxic == 1) for r in got)


def test_scores_against_plain_network(spark):
    """Every window of every text by the equations of the network, one step at a time."""
    p = toxicity.train(["you idiot " * 5 + "x y z", "a nice day " * 5 + "q r"] * 40, [1, 0] * 40, rounds=2)
    texts = ["idiot", "a nice idiot, you!", "fine words " * 30 + "idiot " + "nice day " * 20, "one two three " * 11, None, ""]
    sig = lambda x: 1 / (1 + np.exp(-x))
    h = toxicity.HIDDEN

    def window(words):
        x = [toxicity.vectors(p, toxicity.word_buckets([w]))[0].astype(float) for w in words]
        sides = {}
        for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            state, out = np.zeros(h), {}
            for t in order:
                g = x[t] @ p[f"W{d}"] + p[f"B{d}"]
                r, z = sig(g[:h] + state @ p[f"U{d}"][:, :h]), sig(g[h : 2 * h] + state @ p[f"U{d}"][:, h : 2 * h])
                c = np.tanh(g[2 * h :] + (r * state) @ p[f"U{d}"][:, 2 * h :])
                state = out[t] = (1 - z) * state + z * c
            sides[d] = out
        both = np.array([np.concatenate([sides["f"][t], sides["b"][t]]) for t in range(len(x))])
        e = np.exp(np.tanh(both @ p["A"]) @ p["V"])
        return sig((e[:, None] * both).sum(axis=0) / e.sum() @ p["O"] + p["c"][0])

    for r in toxicity.score_toxicity(frame(spark, texts), p).collect():
        words = toxicity.text_words(r.text)
        scores = [window(words[a:b]) for a, b in toxicity.cut(len(words))] if words else []
        assert r.toxicity.n_windows == len(scores) and abs(r.toxicity.score - max(scores, default=0)) < 1e-3


def test_toxicity_sample(spark):
    """Clashing labels, missing documents and null ids teach nothing and use up no place."""
    rows = [(i, ("you idiot " if i % 2 else "good people ") * 9, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    more = spark.createDataFrame([(i, 1) for i in range(1000, 1400)] + [(None, 1), (None, 0), (5, 0), (5, 1)] + [(7, 1)] * 9, "doc_id long, toxic int")
    one = toxicity.fit(docs, labels.where("doc_id <> 5"), texts=20)
    two = toxicity.fit(docs.union(docs), labels.union(more), texts=20)
    assert all(np.array_equal(one[k], two[k]) for k in one)
    none = toxicity.fit(docs.limit(0), labels)
    assert [r.toxicity.n_windows for r in toxicity.score_toxicity(docs.limit(1), none).collect()] == [1]


def test_toxicity_odd_texts(spark):
    p = toxicity.train(["you idiot " * 5, "a nice day " * 5] * 40, [1, 0] * 40, rounds=2)
    texts = [None, "", "idiot", "nice", "fine words " * 5000 + "idiot " + "fine words " * 5000, "fine words " * 10000]
    got = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(frame(spark, texts).withColumnRenamed("scan", "toxicity"), p).collect()}
    assert got[0].score == got[1].score == 0 and got[0].n_windows == 0
    assert got[2].score > got[3].score and got[4].score > got[5].score and abs(got[4].start - 10000) < 40
    kept = toxicity.drop_toxic(frame(spark, texts).withColumnRenamed("scan", "toxicity"), p, limit=got[2].score)
    assert "toxicity" in kept.columns and 2 not in [r.doc_id for r in kept.collect()]
    same = toxicity.train(["a"], [1])
    assert set(same) == set(p)


# Tokens


def test_token_counts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["", None, " ", "  ", "   a", "a ", "a\n b", "▁", " ▁ x", "<s> </s> <unk>", "a▁▁b ▁c", "\x00a b", "é　 b", "a" * 100 + " " * 70 + "b", "<0x0A> x", "x" * 30000]
    texts = odd + [t for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    cache = f"{shared_folder(spark)}/cache"
    df = frame(spark, texts).withColumnRenamed("scan", "digest")
    for _ in range(2):
        for r in tokens.count_tokens(df, cache, path).collect():
            assert (r.n_tokens, r.n_bytes) == (len(model.encode(r.text or "")), len((r.text or "").encode()))
        assert spark.read.parquet(cache).count() == len({t or "" for t in texts})  # misses are encoded once, and never again
    assert tokens.count_tokens(frame(spark, []), cache, path).count() == 0


def test_equal_texts_are_encoded_once(spark):
    """Also where ids are null or repeated."""
    import public_tokenizers

    path, cache = public_tokenizers.path("piece_bpe_32k.model"), f"{shared_folder(spark)}/cache"
    rows = [(None, "some words")] * 50 + [(1, "more words")] * 1000 + [(1, "other"), (None, "other"), (2, None), (None, "")]
    got = tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), cache, path).collect()
    assert len(got) == len(rows) and all((r.n_tokens == 0) == (not r.text) for r in got)
    assert spark.read.parquet(cache).count() == 4


# Archives


def test_archives_round_trip(spark):
    magic = f"{warc.VERSION}\r\n"

    def fake(n):
        return magic + f"WARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: {n}\r\n\r\nhello\r\n\r\n"

    rows = [(1, "u", "<a>x</a>"), (2, "u", None), (3, None, ""), (4, "u\r\nX: y", f"pre {magic} mid {magic}end"), (5, "u", "<a>x</a>"), (6, "u", fake(5)), (7, "u", "q" + fake(100000)), (8, "u", "é" * 50 + fake(5) + fake(3) + magic), (9, "u", "tail"), (10, "u", f"pre {magic} mid {magic}end")]
    rows += [(100 + i, "u", "z" * (i * 37 % 500) + (magic if i % 7 == 0 else "") + str(i)) for i in range(200)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # so that files are split within records
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        path = f"{shared_folder(spark)}/archives"
        warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), path, per_file=90)
        got = sorted(map(tuple, warc.read_archives(spark, path).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = []
    for i, _, html in rows:
        b = (html or "").encode()
        first = min(j for j, _, h in rows if (h or "") == (html or ""))
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if first < i else "response", first if first < i else None))
    assert got == sorted(want)


def test_small_payloads_stay_responses(spark):
    path = f"{shared_folder(spark)}/archives"
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef"), (None, "u", "abcdef")]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path, least_bytes=4)
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect())
    assert got == [("1", "response", None), ("2", "response", None), ("3", "response", None), ("4", "revisit", 3), ("None", "revisit", 3)]


def test_other_version(spark):
    path = f"{shared_folder(spark)}/archives"
    warc.write_archives(spark.createDataFrame([(1, "u", "abc WARC/1.0\r\n x"), (2, "u", "abc WARC/1.0\r\n x")], "page_id long, url string, html string"), path, version="WARC/1.0")
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(spark, path, "WARC/1.0").collect())
    assert got == [(1, "response", None, 16), (2, "revisit", 1, 16)]
    assert warc.read_archives(spark, path).count() == 0


def test_broken_chains_are_left_out():
    offsets = np.array([0, 50, 80, 120])
    assert warc.reachable(offsets, np.array([80, 80, 120, 200])).tolist() == [True, False, True, True]
    assert warc.reachable(offsets, np.array([60, 80, 120, 200])).tolist() == [True, False, False, False]


def test_archives_sql(spark, duck):
    same_as_sql(registry.QUERIES["op8_warc_chain"](spark, SF), duck, registry.ORACLES["op8_warc_chain"])


# Decontamination


@pytest.mark.parametrize("slice_words", [500_000, 40])
def test_decontamination(spark, slice_words):
    item = " ".join(f"q{i}" for i in range(20))
    bench = [(1, item), (2, "Short one?"), (3, None), (4, " ,"), (10, item), (5, "É É é"), (None, "nameless item"), (6, "nameless")]
    texts = [None, "", "x " + item.upper().replace(" ", "--") + " y", "a short-ONE. b", " ".join(f"q{i}" for i in range(12)), "é é é", "É É é", "w " * 200 + "short one", "q0 " + item, "a nameless item", "a nameless item", "q19 item nameless"]
    docs, items = frame(spark, texts), spark.createDataFrame(bench, "item_id long, text string")
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    for r in decontaminate.scan(docs, items, slice_words=slice_words).collect():
        w = norm(r.text)
        hit, found = set(), set()
        for i, t in bench:
            q = norm(t)
            n = min(13, len(q))
            for k in range(len(q) - n + 1 if q else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == q[k : k + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(i))
        assert (r.scan.n_words, r.scan.hits, r.scan["items"]) == (len(w), sorted(hit), sorted(x for x in found if x != "None"))
        assert r.scan.n_items == len(found)
    left = decontaminate.decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [0, 1, 4, 5, 7]
    passages = {r.doc_id: r.passage for r in decontaminate.hit_passages(docs, items).collect()}
    assert passages[3] == "short-ONE" and passages[2] == item.upper().replace(" ", "--")


def test_equal_items_are_one(spark):
    """Items that are given a thousand times make one slice, and the same result."""
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")] * 1000 + [(2, "one two three")], "item_id long, text string")
    items, n = decontaminate.sliced(bench, 100)
    assert (items.count(), n) == (2, 1)


@pytest.mark.parametrize("items", [[], [(1, None), (2, " ,;")]])
def test_empty_benchmark(spark, items):
    docs = frame(spark, ["some words", None, ""])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(docs, bench).orderBy("doc_id").collect()
    assert [tuple(r.scan) for r in got] == [(2, [], [], 0), (0, [], [], 0), (0, [], [], 0)]
    assert decontaminate.decontaminate(docs, bench).count() == 3 and decontaminate.scan(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("name", ["op4_bbit_minhash", "op9_decontaminate"])
def test_sql(spark, duck, name):
    same_as_sql(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name])
