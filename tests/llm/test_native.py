"""Line rules, mixing and sharding against plain versions."""

import re
from collections import Counter, defaultdict

import numpy as np
from conftest import SF, same_as_sql
from pyspark.sql import functions as F

from keelvault.llm import lines, mixing, registry, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)


def odd_rows():
    common = "a shared footer line of this host\n"
    rows = [(i, f"text number {i} has its own words {' '.join(f'w{i}x{j}' for j in range(30))}\n" + common, "a") for i in range(15)]
    rows += [(100 + i, common * 4, "a") for i in range(3)]
    rows += [(200, None, "a"), (201, "", None), (202, " \t\n\x0b ", "b"), (203, "one two three four five six seven eight " * 9, "b"), (204, "x\n\nx\n x\nX #*$%&|<>", None)]
    rows += [(205, "a a a a a a a a a", "b"), (206, "a b c d e f g h\ta b c d e f g h", "b"), (207, "word " * 40, "c"), (207, "word " * 40, "c"), (None, "null id " * 20, "c")]
    # Rows that repeat an id are one document, also those without one.
    rows += [(300, "said by one document " * 8, "d")] * 1000 + [(None, "said without an id " * 8, "d")] * 30
    return rows


def plain_lines(rows):
    seen = defaultdict(lambda: defaultdict(set))
    key = lambda x: re.sub(r"[\x20\x09-\x0D]+", "", x).lower()
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            if WORD.search(x):
                seen[s][key(x)].add(i)
    often = {s: {k for k, ids in c.items() if len(ids) > 10} for s, c in seen.items()}
    out = []
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        own = [x for x in t.split("\n") if WORD.search(x)]
        where = defaultdict(list)
        for p in range(len(w) - 7):
            where[tuple(w[p : p + 8])].append(p)
        rep = {q for ps in where.values() if len(ps) > 1 for p in ps for q in range(p, p + 8)}
        left = len(w) - sum(len(WORD.findall(x)) for x in own if key(x) in often.get(s, ()))
        failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(own) - len(set(own)), len(rep), left, failed, not failed and left >= 20 and left >= 0.5 * len(w)))
    return out


def test_line_rules(spark):
    rows = odd_rows()
    got = [tuple(r) for r in lines.judge(docs_frame(spark, rows).withColumn("kept", F.col("lang"))).collect()]
    assert sorted(got, key=str) == sorted(plain_lines(rows), key=str)
    assert lines.judge(docs_frame(spark, [])).count() == 0


def test_clean_removes_frequent_lines(spark):
    out = lines.clean(docs_frame(spark, odd_rows())).collect()
    by_id = {r.doc_id: r.text for r in out}
    assert set(range(15)) <= set(by_id) and not {100, 101, 102, 200} & set(by_id)
    assert all("shared footer" not in by_id[i] and f"text number {i} " in by_id[i] for i in range(15))


def test_lines_of_large_hosts_are_removed(spark):
    """A line of 20 documents goes and one of 10 stays, also where they are under 0.5 % of the host."""
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(25)) + "\n"
    rows = [(i, own(i) + ("shared by twenty\n" if i < 20 else "") + ("shared by ten\n" if 40 <= i < 50 else ""), "a") for i in range(4200)]
    got = {r.doc_id: r.n_words - r.n_words_left for r in lines.judge(docs_frame(spark, rows)).collect()}
    assert {i for i, n in got.items() if n} == set(range(20)) and got[0] == 3


def test_line_rules_sql(spark, duck):
    same_as_sql(registry.QUERIES["op1_line_frequency"](spark, SF), duck, registry.ORACLES["op1_line_frequency"])


def test_mix_sql(spark, duck):
    same_as_sql(registry.QUERIES["op10_mix_sources"](spark, SF), duck, registry.ORACLES["op10_mix_sources"])


def plain_targets(sizes, most=3, weights=(1, 2, 3)):
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: rest * weight[s] / w for s in free}
        over = {s: float(most * sizes[s]) for s in free if share[s] > most * sizes[s]}
        if not over:
            return fixed | share
        fixed |= over


def test_mix(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), [None, "a", "b", "c", "tiny", "none"][int(rng.integers(0, 5))]) for i in range(600)]
    rows = [r for r in rows if r[2] != "tiny" or r[0] < 60] + [(9001, None, "none"), (9002, "", "none"), (7, "dup dup", "a"), (7, "dup dup", "a"), (None, "null id", "b")]
    docs = docs_frame(spark, rows).withColumn("taken", F.col("n_chars"))
    got = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    again = mixing.mix(docs.repartition(7)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(docs_frame(spark, [])).count() == 0


def test_mix_of_equal_rows(spark):
    """Of equal rows, also those without an id, as many are taken as fit."""
    rows = [(None, "w " * 10, "a")] * 900 + [(3, "v " * 300, "a")] * 100 + [(3, "v " * 500, "a")] * 20 + [(i, "u " * 10, "b") for i in range(10, 40)]
    docs = docs_frame(spark, rows).withColumn("target", F.lit("own"))
    got = mixing.mix(docs.drop("target"), weights=(1, 200)).collect()
    total = Counter()
    for r in got:
        total[r.source] += r.taken
        assert r.taken in (r.size * k for k in range(4))
    want = plain_targets({"a": 9000 + 30000 + 10000, "b": 300}, 3, (1, 200))
    assert all(abs(total[s] - want[s]) <= 500 for s in want)
    again = mixing.repeated(docs).collect()
    assert all(r.target == "own" for r in again)


def test_targets_of_many_sources(spark):
    """Ordered in ranges, the targets are those that one task gives."""
    rng = np.random.default_rng(3)
    sizes = spark.createDataFrame([(None if i == 7 else f"s{i:05}", int(rng.integers(0, 500))) for i in range(700)], "source string, source_size long")
    one = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    many = {r.source: r.target for r in mixing.source_targets(sizes, single=10).collect()}
    assert one == many and len(one) == 700
    want = plain_targets({r.source: r.source_size for r in sizes.collect()})
    assert all(abs(one[s] - want[s]) < 1e-6 for s in want)


def test_heavier_documents_come_first(spark):
    """Of documents with equal sizes those with ten times the weight are taken far more often."""
    docs = docs_frame(spark, [(i, "w " * 10, "a" if i < 2000 else "b") for i in range(4000)])
    got = mixing.mix(docs, quality=lambda size: F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.1)).where("source = 'a'")
    n = {r[0]: r[1] for r in got.groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.count_if(F.col("taken") > 0)).collect()}
    assert n[0] > 2.5 * n[1] > 0


def test_matrix_is_hypergeometric():
    counts = [7, 0, 120, 33]
    for seed in range(20):
        m = np.array(sharding.communication_matrix(counts, 5, seed))
        assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == [32] * 5
    first = np.array([sharding.communication_matrix([100, 100], 2, s)[0][0] for s in range(3000)])
    assert abs(first.mean() - 50) < 0.4 and abs(first.var() - 100 * 100 * 100 * 100 / 200**2 / 199) < 1.5
    rng = np.random.default_rng(0)
    big = np.array([sharding.hypergeometric(rng, 4 * 10**9, 6 * 10**9, 10**4) for _ in range(400)])
    assert abs(big.mean() - 4000) < 10 and 35 < big.std() < 64


def test_shards(spark):
    rows = [(i % 90, f"t{i % 80}", None if i % 3 else "a") for i in range(1003)] + [(None, None, None)] * 4
    df = docs_frame(spark, rows).withColumn("slot", F.col("n_chars"))
    got = sharding.shuffle_to_shards(df).collect()
    assert sorted(str((r.doc_id, r.text, r.source)) for r in got) == sorted(str(r) for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and {len(v) for v in by.values()} <= {125, 126}
    again = sharding.shuffle_to_shards(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sharding.shuffle_to_shards(docs_frame(spark, [])).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        other = sharding.shuffle_to_shards(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(map(str, other)) == sorted(map(str, got))
    ids = [r.doc_id for r in sharding.shuffle_to_shards(docs_frame(spark, [(i, "t", "a") for i in range(4000)])).where("shard = 0").orderBy("slot").collect()]
    assert abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.15


def test_equal_rows_are_spread(spark, monkeypatch):
    """Copies of one row go to all shards and slots like any others."""
    monkeypatch.setattr(sharding, "COPIES", 50)
    rows = [(1, "same", "a")] * 800 + [(None, None, None)] * 3 + [(i, "t", "b") for i in range(10, 210)]
    df = docs_frame(spark, rows).withColumn("tags", F.create_map(F.lit("k"), F.col("source")))
    got = sharding.shuffle_to_shards(df, partitions=32).collect()
    assert sorted(str((r.doc_id, r.text, r.source)) for r in got) == sorted(str(r) for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and {len(v) for v in by.values()} <= {125, 126}
    copies = Counter(r.shard for r in got if r.doc_id == 1)
    assert len(copies) == 8 and min(copies.values()) > 75
    again = sharding.shuffle_to_shards(df.repartition(5), partitions=32).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
