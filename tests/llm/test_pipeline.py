"""The pipeline, stage by stage, against plain versions on what each stage got."""

from collections import Counter

from conftest import SF
from test_texts import plain_components

import corpus_pipeline
from keelvault.llm import toxicity
from keelvault.llm.common import documents, stored


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = documents(spark, SF)
    got = [docs]
    for name, stage in corpus_pipeline.STAGES:
        got.append(stored(stage(spark, got[-1], SF), name))
    assert all(df.columns == docs.columns for df in got[:-1])
    rows = [df.collect() for df in got]
    ids = [[r.doc_id for r in x] for x in rows]

    network = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.toxicity.score for r in toxicity.score_toxicity(docs, network).collect()}
    assert sorted(ids[1]) == sorted(i for i in ids[0] if scores[i] < 0.5)

    texts = sorted((r.doc_id, r.text) for r in rows[1])
    assert sorted(ids[2]) == sorted(i for i, _, _, kept in plain_components(texts, 5) if kept)

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    from keelvault.llm import decontaminate

    windows = set()
    for r in bench.collect():
        w = decontaminate.normal_words(r.text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()

    def clean(text):
        w = decontaminate.normal_words(text)
        hit = set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
        return not (hit and 20 * len(hit) >= len(w))

    assert sorted(ids[3]) == sorted(r.doc_id for r in rows[2] if clean(r.text))

    before, after = Counter(ids[3]), Counter(ids[4])
    assert set(after) <= set(before) and max(after.values()) <= 3
    sizes, taken = Counter(), Counter()
    words = {r.doc_id: len(r.text.split()) for r in rows[3]}
    for r in rows[3]:
        sizes[r.source] += words[r.doc_id]
    for r in rows[4]:
        taken[r.source] += words[r.doc_id]
    assert abs(sum(taken.values()) - sum(sizes.values())) < 0.05 * sum(sizes.values())

    assert sorted(ids[5]) == sorted(ids[4])
    shards = Counter(r.shard for r in rows[5])
    assert max(shards.values()) - min(shards.values()) <= 1 and len({(r.shard, r.slot) for r in rows[5]}) == len(rows[5])


def test_mixing_keeps_empty_texts(spark):
    """Texts without words are repeated by the epochs of their source."""
    rows = [(i, "some words here", s) for i, s in enumerate(["a", "b"] * 20)] + [(100, None, "a"), (101, "", "a"), (102, " \n", "a"), (103, None, "b"), (104, "", "b"), (105, None, "none")]
    docs = spark.createDataFrame(rows + [(200 + i, "some more words", "a") for i in range(200)], "doc_id long, text string, source string")
    got = Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SF).collect())
    assert {got[i] for i in (103, 104)} <= {3} and all(got[i] == 3 for i in range(1, 40, 2))
    assert all(got[i] <= 1 for i in (100, 101, 102)) and got[105] == 1


def test_stages_on_odd_tables(spark):
    """Every stage on nulls in all columns, empty and very long texts, repeated rows, clashing columns and no rows."""
    long = " ".join(f"long{i % 5000}" for i in range(40_000))
    rows = [(1, "plain words in a text", "a"), (1, "plain words in a text", "a"), (2, None, None), (None, "no id here at all", "a"), (None, None, None), (3, "", "b"), (4, " \n\t", "b"), (5, long, "b"), (6, long, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = ["toxicity", "scan", "node", "component_id", "size", "target", "times", "_kv", "digest", "hits"]
    for name in clash:
        docs = docs.withColumn(name, docs.source)
    for name, stage in corpus_pipeline.STAGES:
        got = stored(stage(spark, docs, SF), name)
        out = got.collect()
        new = ["shard", "slot"] if name == "sharding" else []
        assert got.columns == docs.columns + new, name
        assert all(r[c] == r.source for r in out for c in clash), name
        assert {str((r.doc_id, r.text, r.source)) for r in out} <= {str(r) for r in rows}, name
        counts = Counter(str(r.doc_id) for r in out)
        if name in ("toxicity", "decontamination", "sharding"):
            assert counts == Counter(str(i) for i, _, _ in rows), name
        if name == "near_duplicates":
            assert counts == Counter({"1": 2, "2": 1, "None": 2, "3": 1, "4": 1, "5": 1}), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
