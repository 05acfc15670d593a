"""Prefix joins, phrase counts and filter audits against plain versions."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF, same_as_sql

from keelvault.llm import collocations, filteraudit, prefixjoin, registry

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_prefix_join", "op12_collocations", "op13_filter_audit"])
def test_sql(spark, duck, name):
    assert same_as_sql(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name]) > 0


# Prefix joins


def plain_join(rows, width, percent):
    """Components over all pairs, on sets of tuples."""
    sets = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    part = {i: i for i, _ in rows if i is not None}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for (i, a), (j, b) in itertools.combinations([s for s in sets if s[0] is not None], 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b) and root(i) != root(j):
            part[max(root(i), root(j))] = min(root(i), root(j))
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def joined(spark, rows, width=4, percent=85, names=""):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in names.split():
        docs = docs.withColumn(n, docs.doc_id)
    return sorted((tuple(r) for r in prefixjoin.prefix_join(docs, width, percent).collect()), key=str)


def drifting(seed, bases=6, copies=14):
    """Families of texts that drift apart by single words, with a passage that all families share, so that
    links form chains and many pairs are just above or below the limit."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [rng.choice(words) for _ in range(25)]
    rows = []
    for _ in range(bases):
        text = [rng.choice(words) for _ in range(rng.randint(30, 90))] + shared
        for _ in range(copies):
            if rng.random() < 0.8:
                text = list(text)
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.2:
                text = [*text, rng.choice(words)]
            rows.append(" ".join(text if rng.random() < 0.9 else reversed(text)))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,block,cells,large", [(1, 512, 22, 64), (2, 5, 10, 3)])
def test_prefix_join(spark, monkeypatch, seed, block, cells, large):
    """Equal to all pairs, also with small blocks and few cells."""
    monkeypatch.setattr(prefixjoin, "BLOCK", block)
    monkeypatch.setattr(prefixjoin, "CELL_BITS", cells)
    monkeypatch.setattr(prefixjoin, "LARGE", large)
    rows = drifting(seed)
    got = joined(spark, rows)
    assert got == plain_join(rows, 4, 85) and len({c for _, _, c in got}) < len(rows) - 20


def test_prefix_join_odd_tables(spark):
    long = " ".join(f"x{i % 5000}" for i in range(30_000))
    rows = [(5, None), (4, ""), (3, " \t\n"), (9, "one two"), (8, "ONE\ttwo"), (7, "one"), (6, "Ünï cödé wörds hëre éé"), (2, "Ünï cödé wörds hëre éé"), (None, "one two"), (11, long), (12, long + " end"), (13, "a b c d e"), (14, "a b c d e f")]
    assert joined(spark, rows, names="grp n node bits head component _kv_node") == plain_join(rows, 4, 85)
    # Rows of one id are one document: 1 ties what its two texts link with.
    twice = joined(spark, [(1, "p q r s t u"), (1, "k l m n o p"), (2, "p q r s t u"), (3, "k l m n o p"), (0, "k l m n o p")])
    assert {i: c for i, _, c in twice} == {0: 0, 1: 0, 2: 0, 3: 0}
    assert joined(spark, []) == []


def test_order_puts_frequent_cells_last():
    counts = np.random.default_rng(3).poisson(40, 4096)
    counts[7] = 100_000
    full = prefixjoin.fullness(counts)
    assert full[7] == full.max() and full[counts.argmin()] == 0 and len(np.unique(full)) > 20
    assert (np.diff(full[np.argsort(counts, kind="stable")].astype(int)) >= 0).all()


# Collocations


def plain_collocations(rows, longest=3, least=10, contained=50, top=2000):
    """Counts in dictionaries, phrase by phrase."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = (lang, tuple(w[i : i + k]))
                    f[key] = f.get(key, 0) + 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in found.items():
        if any(x == lang and len(y) > len(w) and 100 * b >= contained * a and any(y[i : i + len(w)] == w for i in range(len(y) - len(w) + 1)) for (x, y), b in found.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, c in out.items() for i, (s, a, p, x, y) in enumerate(sorted(c)[:top], 1))


def phrase_rows(seed=4):
    rng = random.Random(seed)
    words = ["New", "york", "city", "the", "of", "a", "é", "ß", "|", "　x", "x\x1cy", "\x85"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ". ", "\n", "! ", " "]) for _ in range(rng.randint(0, 80)))
        rows.append((rng.choice(["en", "de", None, "und", ""]), text))
    return [*rows, ("en", None), ("fr", ""), ("xx", " ,.; "), ("en", "the the the " * 3000), *[("en", "one in a row")] * 12]


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, monkeypatch, small):
    """Equal to plain counts; with small containers, spills, renumbering, spread prefixes and a full Bloom filter too."""
    if small:
        for name, value in (("BURST", 8), ("HELD", 20), ("NUMBERED", 6), ("CHUNK", 50), ("HOT", 1), ("BLOOM_BITS", 7)):
            monkeypatch.setattr(collocations, name, value)
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("lang", "text", "1 AS h", "2 AS ids", "3 AS part", "4 AS n")
    got = sorted(tuple(r) for r in collocations.collocations(docs.repartition(5), least=4).collect())
    assert got == plain_collocations(rows, least=4) and len(got) > 100
    pairs = sorted(tuple(r) for r in collocations.collocations(docs, longest=2, least=4, top=7).collect())
    assert pairs == plain_collocations(rows, 2, 4, 50, 7)


def test_collocations_without_candidates(spark):
    docs = spark.createDataFrame([(None, "a b c"), ("en", None)], "lang string, text string")
    assert collocations.collocations(docs).count() == 0 and collocations.collocations(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(docs, longest=4)


def test_clashing_hashes_are_found(spark, monkeypatch):
    """A hash that stands for two words is seen, and another seed taken."""
    import pandas as pd

    h = np.array([1, 2], np.uint64).tobytes()
    rows = [("en", 0, h, np.array([5, 6], np.uint64).tobytes(), np.array([3, 9], np.int64).tobytes(), b"a\nb"), ("en", 0, h, np.array([5, 7], np.uint64).tobytes(), np.array([3, 9], np.int64).tobytes(), b"a\nc")]
    frame = pd.DataFrame(rows, columns=["lang", "part", "hashes", "checks", "counts", "words"])
    got = collocations.word_merger(4)(frame)
    assert got["clash"].any() and got["n"].iloc[-1] == 24
    got = collocations.word_merger(4)(pd.concat([frame.iloc[:1]] * 2))
    assert not got["clash"].any() and sorted(got["word"].dropna()) == ["a", "b"] and got["n"].tolist() == [6, 18, 24]


def test_trie_counts(monkeypatch):
    monkeypatch.setattr(collocations, "BURST", 64)
    rng = np.random.default_rng(2)
    trie, plain, spilled = collocations.Trie(3), Counter(), Counter()
    for _ in range(30):
        ids = rng.zipf(1.3, (2000, 3)).clip(1, 5000).astype(np.int64)
        packed, counts = np.unique((ids[:, 0] << 42) | (ids[:, 1] << 21) | ids[:, 2], return_counts=True)
        trie.add(packed, counts)
        plain.update(dict(zip(packed.tolist(), counts.tolist(), strict=True)))
        if trie.size() > 20_000:
            keys, n = trie.spill(8_000)
            assert len(keys) >= 8_000 and (np.diff(keys) > 0).all()
            spilled.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
    assert trie.nodes and any(x.nodes for x in trie.nodes.values())
    keys, n = trie.spill(trie.size())
    spilled.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
    assert spilled == plain and trie.size() == 0


# Filter audits


def plain_audit(docs, labels):
    """Every order of the filters, document by document."""
    quality = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in quality, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        steps, removals = [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone = [r for r in left if k in r[1]]
                left = [r for r in left if k not in r[1]]
                before = set(order[: step - 1])
                removals[k] += len(gone)
                steps.append((part, "".join(order), step, len(left), len(gone), sum(k in r[1] and bool(r[1] & before) for r in own), sum(r[1] == {k} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), k))
        out += [(*s[:-1], removals[s[-1]]) for s in steps]
    return sorted(out)


def audit_rows():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    docs = []
    for i in range(80):
        text = " ".join(rng.choice(words[: rng.choice([20, 500])]) for _ in range(rng.choice([5, 150, 199, 200, 260])))
        text += rng.choice(["", "", " #", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3, "É" * 50])
        docs.append((i, text, rng.choice(["en", "de", None])))
    docs += [(100 + i, docs[rng.randrange(40)][1], rng.choice(["en", ""])) for i in range(15)]
    docs += [(200, None, "en"), (201, "", "de"), (None, "", "en"), (None, docs[0][1], "en"), docs[3], docs[3], (docs[4][0], "other # text", "de")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 90, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (6, None, None)]
    return docs, labels


def audit_frames(spark):
    docs, labels = audit_rows()
    return spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS n", "2 AS cell", "3 AS good", "4 AS digest"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS part")


def test_audit(spark):
    """Equal to going through every order; nulls, repeated rows and ids, clashing names."""
    docs, labels = audit_frames(spark)
    got = sorted(tuple(r) for r in filteraudit.audit(docs, labels).collect())
    assert got == plain_audit(*audit_rows())


def test_audit_empty_tables(spark):
    docs, labels = audit_frames(spark)
    assert filteraudit.audit(docs.limit(0), labels).count() == 0
    none = filteraudit.audit(docs, labels.limit(0)).collect()
    assert len(none) == 3 * 600 and sum(r.good_lost + r.toxic_lost for r in none) == 0


def test_trace_gives_removed_ids(spark):
    docs, labels = audit_frames(spark)
    rows = filteraudit.facts(docs, labels, "lang", {k: f() for k, f in filteraudit.RULES.items()})
    tables = filteraudit.failing_ids(rows, "ABCDE")
    got = Counter()
    for r in filteraudit.trace(rows, tables, "EDCBA").collect():
        got[r.part, r.step] += r.n
    want = {(part, step): removed for part, order, step, _, removed, *_ in plain_audit(*audit_rows()) if order == "EDCBA" and removed}
    assert got == want
    digest = hashlib.sha256(b"").hexdigest()
    assert {r.doc_id for r in tables["E"].where(f"digest = '{digest}'").collect()} == {201}
