"""Near-duplicate documents by b-bit MinHash, with links confirmed on the full shingle sets.

1. One pass over the texts makes a sketch of each: its number of distinct shingles, a digest of the
   set, band keys of its minima, and the low bits of all minima, packed.
2. Documents with equal sets are one class, known by its smallest id. Only classes go on.
3. In each bucket of a band every member is paired with the smallest one, so pairs are linear in
   the bucket. The packed bits give a collision-corrected estimate of the similarity that drops
   pairs far below the limit; the rest are confirmed on the texts, and connected components follow.
4. Buckets that still hold several components are paired once more, with the member that lies in
   the largest buckets, since it is the least changed one of its group.
5. What then remains: members outside a bucket's largest component are held against all of the
   bucket that they aren't connected with; in small buckets as a join whose condition holds the
   estimate, in large ones in blocks of bounded size. A block first meets with signatures alone and
   says which of its rows have a partner by the estimate; only these come again with their texts,
   and what comes out are links. So no pair of a bucket stays unseen unless its ends are connected,
   and pairs of a group are never written out.

Frequent sets, buckets and components are keys of joins between stored tables, both sides of which
Spark exchanges by itself, so that it can split what is skewed.

A pair at the limit shares no bucket with probability (1 - 0.8 ** ROWS) ** BANDS, 1.2e-5; its
estimate falls below what is confirmed with probability 5e-6."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelvault.llm.common import documents, stored

ROWS, BANDS, BITS = 7, 48, 4
#: Estimates have a standard deviation of 0.023 at the limit; pairs more than four of them below are dropped.
MARGIN = 0.1
#: Buckets of more members are worked on in blocks of so many rows.
LARGE, BLOCK = 64, 512
#: Sets of ids up to so many rows are broadcast to the texts; beyond, both sides are shuffled.
BROADCAST_IDS = 300_000

SKETCH = T.StructType([T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.ArrayType(T.LongType()))])


def sketcher(width: int):
    """text -> SKETCH of its distinct ``width``-word shingles, as a column function."""
    rows, bands, bits = ROWS, BANDS, BITS

    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        k = rows * bands
        rng = np.random.default_rng(4)
        a = rng.integers(0, 2**64, (k, 1), dtype=np.uint64) | np.uint64(1)
        b = rng.integers(0, 2**64, (k, 1), dtype=np.uint64)
        mix = rng.integers(0, 2**64, max(rows, width), dtype=np.uint64) | np.uint64(1)
        salt = rng.integers(0, 2**64, bands, dtype=np.uint64)
        per = 64 // bits
        place = (np.arange(k, dtype=np.uint64) % np.uint64(per)) * np.uint64(bits)

        class Hashes(dict):
            def __missing__(self, word):
                if len(self) > 300_000:
                    self.clear()
                value = self[word] = xxhash.xxh64_intdigest(word)
                return value

        of = Hashes().__getitem__
        for batch in batches:
            counts, digests, keys, packed, lengths = [], [], [], [], []
            for value in batch:
                words = (value.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                if not words:
                    counts.append(0)
                    digests.append(None)
                    lengths.append(0)
                    continue
                h = np.fromiter(map(of, words), np.uint64, len(words))
                n = max(1, len(h) - width + 1)
                x = np.zeros(n, np.uint64)
                for i in range(min(width, len(h))):
                    x = (x ^ (x >> np.uint64(29))) * mix[i] + h[i : i + n]
                x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
                x = np.unique(x ^ (x >> np.uint64(29)))
                low = np.full((k, 1), 2**64 - 1, np.uint64)
                for i in range(0, len(x), 4096):  # bounded memory for long texts
                    low = np.minimum(low, (a * x[i : i + 4096] + b).min(axis=1, keepdims=True))
                low = low[:, 0]
                band = (low.reshape(bands, rows) * mix[:rows]).sum(axis=1, dtype=np.uint64)
                band = (band ^ (band >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + salt
                sig = np.bitwise_or.reduce(((low & np.uint64(2**bits - 1)) << place).reshape(-1, per), axis=1)
                counts.append(len(x))
                digests.append(xxhash.xxh3_128_digest(x.tobytes()))
                keys.append(band)
                packed.append(sig)
                lengths.append(1)
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)

            def lists(parts, each, ends=ends):
                flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
                return pa.ListArray.from_arrays(pa.array(ends * each, pa.int32()), pa.array(flat, pa.int64()))

            arrays = [pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists(keys, bands), lists(packed, k // per)]
            yield pa.StructArray.from_arrays(arrays, names=["n", "digest", "bands", "sig"])

    return F.arrow_udf(sketch, SKETCH).asNondeterministic()


def estimate(one: Column, other: Column) -> Column:
    """Similarity of two packed signatures: the share of equal fields, corrected for chance collisions."""
    lowest = F.lit(0x1111111111111111)
    different = F.lit(0)
    for i in range(ROWS * BANDS * BITS // 64):
        x = F.get(one, F.lit(i)).bitwiseXOR(F.get(other, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        different = different + F.bit_count(x.bitwiseAND(lowest))
    share = 1 - different / float(ROWS * BANDS)
    chance = 2.0**-BITS
    return (share - chance) / (1 - chance)


def shingle_set(text: str | None, width: int) -> set:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return set()
    return set(zip(*[words[i:] for i in range(width)], strict=False)) if len(words) >= width else {tuple(words)}


def reaches(a: set, b: set, percent: int) -> bool:
    both = len(a & b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def confirmer(width: int, percent: int):
    """(text, text) -> whether the shingle sets reach the similarity, as a column function."""

    def confirm(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known, of_known = None, set()
        for one, other in batches:
            out = []
            for x, y in zip(one, other, strict=True):
                x = x.as_py()
                if x != known or known is None:
                    known, of_known = x, shingle_set(x, width)
                out.append(reaches(of_known, shingle_set(y.as_py(), width), percent))
            yield pa.array(out, pa.bool_())

    return F.arrow_udf(confirm, "boolean").asNondeterministic()


def near(ids: DataFrame) -> DataFrame:
    """``ids`` with a broadcast hint if it is small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the documents whose ids are in ``nodes`` (node)."""
    wanted = stored(nodes.select(F.col("node").alias("_kv_node")).distinct(), "wanted")
    return stored(docs.join(near(wanted), F.col("doc_id") == F.col("_kv_node"), "left_semi").select(F.col("doc_id").alias("node"), "text"), "texts")


def confirmed(likely: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of class ids those whose texts are links."""
    likely = stored(likely.select("a", "b").distinct(), "likely")
    texts = texts_of(likely.select(F.explode(F.array("a", "b")).alias("node")), docs)
    both = likely.join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b").join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
    return stored(both.withColumn("_kv_link", confirmer(width, percent)("text_a", "text_b")).where("_kv_link").select("a", "b").distinct(), "links")


def star_links(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links among the pairs (a, b) of members with their bucket's leader, by estimate and then by the texts."""
    sigs = sketches.select("node", "sig")
    joined = pairs.distinct().join(sigs.withColumnsRenamed({"node": "a", "sig": "sig_a"}), "a").join(sigs.withColumnsRenamed({"node": "b", "sig": "sig_b"}), "b")
    return confirmed(joined.where(estimate(F.col("sig_a"), F.col("sig_b")) >= percent / 100 - MARGIN), docs, width, percent)


def partners(s: pd.DataFrame, m: pd.DataFrame, bucket: int, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``s`` (by place) the rows of ``m`` that may be linked with it: of another component,
    with a likely estimate, and not met in an earlier band."""
    s_bands, m_bands = np.stack(s["bands"].to_list()), np.stack(m["bands"].to_list())
    s_sig, m_sig = (np.stack(x["sig"].to_list()).view(np.uint64) for x in (s, m))
    s_comp, m_comp = s["component"].to_numpy(), m["component"].to_numpy()
    here = int((s_bands[0] == bucket).argmax())
    chance = 2.0**-BITS
    for i in range(len(s)):
        apart = np.flatnonzero(m_comp != s_comp[i])
        x = m_sig[apart] ^ s_sig[i]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        different = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1)
        likely = apart[(1 - different / (ROWS * BANDS) - chance) / (1 - chance) >= least]
        yield i, likely[~(m_bands[likely, :here] == s_bands[i, :here]).any(axis=1)]


def block_flagger(percent: int):
    """(bucket, node, component, stray, _kv_i, _kv_j) of the rows of one block that have a likely partner in it."""
    least = percent / 100 - MARGIN

    def flag(group: pd.DataFrame) -> pd.DataFrame:
        stray = group["stray"].to_numpy()
        s, m = group[stray], group[~stray]
        some_s, some_m = np.zeros(len(s), bool), np.zeros(len(m), bool)
        if len(s) and len(m):
            for i, found in partners(s, m, group["bucket"].iloc[0], least):
                some_s[i] = len(found) > 0
                some_m[found] = True
        return pd.concat([s[some_s], m[some_m]])[["bucket", "node", "component", "stray", "_kv_i", "_kv_j"]]

    return flag


def block_meeter(width: int, percent: int):
    """Links of one block: rows of strays against rows of other members of a bucket, with their texts.
    A pair counts only while its ends are not known to be connected."""
    least = percent / 100 - MARGIN

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        links: list[tuple[int, int]] = []
        stray = group["stray"].to_numpy()
        s, m = group[stray], group[~stray]
        if len(s) and len(m):
            s_comp, m_comp = s["component"].to_numpy(), m["component"].to_numpy()
            s_text, m_text = s["text"].to_list(), m["text"].to_list()
            s_node, m_node = s["node"].to_list(), m["node"].to_list()
            sets: dict[int, set] = {}
            parent: dict[int, int] = {}

            def root(x):
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            for i, found in partners(s, m, group["bucket"].iloc[0], least):
                own = None
                for j in found:
                    a, b = root(s_comp[i]), root(m_comp[j])
                    if a == b:
                        continue
                    own = shingle_set(s_text[i], width) if own is None else own
                    if j not in sets:
                        sets[j] = shingle_set(m_text[j], width)
                    if reaches(own, sets[j], percent):
                        links.append((s_node[i], m_node[j]))
                        parent[max(a, b)] = min(a, b)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return meet


def block_links(large: DataFrame, sketches: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between strays and other members of large buckets (bucket, node, component, stray, n, strays)."""
    h = F.xxhash64("node", F.lit(4))
    _m, _s = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n", "strays"))
    # Each member meets its sketch once, before it is dealt to blocks.
    placed = large.select("bucket", "node", "component", "stray", _m.alias("_kv_m"), _s.alias("_kv_s")).join(sketches, "node")
    one, every = F.pmod(h, F.col("_kv_s")).cast("int"), F.pmod(h, F.col("_kv_m")).cast("int")
    own = ["bucket", "node", "component", "bands", "sig"]
    against = placed.select(*own, F.lit(False).alias("stray"), every.alias("_kv_j"), F.explode(F.sequence(F.lit(0), F.col("_kv_s") - 1)).alias("_kv_i"))
    held = placed.where("stray").select(*own, F.lit(True).alias("stray"), F.explode(F.sequence(F.lit(0), F.col("_kv_m") - 1)).alias("_kv_j"), one.alias("_kv_i"))
    block = ["bucket", "_kv_i", "_kv_j"]
    # A group is a block of strays and a block of members.
    flagged = stored(against.unionByName(held).groupBy(*block).applyInPandas(block_flagger(percent), "bucket long, node long, component long, stray boolean, _kv_i int, _kv_j int"), "flagged")
    if flagged.isEmpty():
        return flagged.select(F.col("node").alias("a"), F.col("node").alias("b"))
    full = flagged.join(texts_of(flagged, docs).join(sketches, "node"), "node")
    return stored(full.groupBy(*block).applyInPandas(block_meeter(width, percent), "a long, b long").distinct(), "more")


def mixed_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of buckets that hold several components: (bucket, node, leader, component, major, n, strays)."""
    told = members.join(labels, "node", "left").select("bucket", "node", "leader", F.coalesce("component", "node").alias("component"))
    sizes = told.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    totals = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("strays"))
    return stored(told.join(totals.where("strays > 0"), "bucket"), "mixed")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``links`` (a, b) reaches.

    Each round every vertex takes the smallest of itself and its neighbours, twice over, and the
    edges are contracted accordingly; labels only fall, and the graph is done when no edge is left."""
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    while not edges.isEmpty():
        least = stored(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        second = least.select(F.col("a").alias("m"), F.col("m").alias("mm"))
        step = stored(least.join(second, "m").select(F.col("a").alias("v"), F.col("mm").alias("m")), "step")
        labels = stored(labels.join(step, F.col("component") == F.col("v"), "left").select("node", F.coalesce("m", "component").alias("component")), "labels")
        to_a = step.withColumnsRenamed({"v": "a", "m": "ma"})
        to_b = step.withColumnsRenamed({"v": "b", "m": "mb"})
        # Contracting keeps vertices of a connected part connected: each edge stays or its ends meet.
        moved = edges.join(to_a, "a").join(to_b, "b").select(F.col("ma").alias("a"), F.col("mb").alias("b"))
        kept = step.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        kept = kept.join(step.select(F.col("m").alias("a")).distinct(), "a", "left_semi")  # labels still in use
        both = moved.unionByName(kept).unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = stored(both.where("a <> b").distinct(), "edges")
    return labels


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text, ...).

    Words are lower-cased (A-Z) runs without white space; a text of fewer than ``width`` words is
    one shingle. Null texts and texts without words have no shingles and link with nothing. Rows
    that repeat a doc_id are one document: a link of either is a link of both. A null doc_id can't
    be reached: its component_id is null, it is kept, and nothing links through it. An empty table
    gives an empty table. Texts of any length are read whole. Other columns are not read."""
    docs = docs.select("doc_id", "text")
    made = stored(docs.select("doc_id", sketcher(width)("text").alias("s")).select("doc_id", "s.*"), "sketches")
    # Sets that several rows have, with the smallest of their ids; all other documents are classes of their own.
    named = made.where("n > 0 AND doc_id IS NOT NULL")
    shared = named.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")).where("copies > 1")
    shared = near(stored(shared.select(F.col("digest").alias("_kv_digest"), "node"), "shared"))
    met = made.join(shared, F.col("digest") == F.col("_kv_digest"), "left")
    rows = stored(met.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node")), "rows")
    sketched = met.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "node", "bands", "sig")
    heads = sketched.where("node = doc_id").dropDuplicates(["doc_id"])
    sketches = stored(sketched.where("node IS NULL").unionByName(heads).select(F.col("doc_id").alias("node"), "bands", "sig"), "classes")
    # Rows with one id but several sets tie the classes of these together.
    torn = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select(F.col("doc_id").alias("_kv_id"))
    own = stored(rows.join(near(stored(torn, "torn")), F.col("doc_id") == F.col("_kv_id"), "left_semi").where("n > 0 AND node <> doc_id").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct(), "own")

    spread = sketches.select("node", F.explode("bands").alias("bucket"))
    buckets = spread.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("_kv_last")).where("leader <> _kv_last").drop("_kv_last")
    members = stored(spread.join(stored(buckets, "buckets"), "bucket"), "members")
    links = own.unionByName(star_links(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")), sketches, docs, width, percent))
    labels = components(links)

    mixed = mixed_buckets(members, labels)
    middle = mixed.groupBy("node").agg(F.sum("n").alias("weight"))
    middles = mixed.join(middle, "node").groupBy("bucket").agg(F.max_by(F.struct("node", "component"), F.struct("weight", "node")).alias("x"))
    again = mixed.join(middles, "bucket").where("component <> x.component").select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b"))
    links = links.unionByName(star_links(again, sketches, docs, width, percent))
    labels = components(links)

    mixed = mixed_buckets(members, labels)
    stray = F.col("component") != F.col("major")
    small = mixed.where(F.col("n") <= LARGE).join(sketches.select("node", "sig"), "node")
    small = stored(small.select("bucket", "node", "component", "sig", stray.alias("stray")), "small")
    x, y = small.where("stray").alias("x"), small.alias("y")
    apart = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") != F.col("y.component"))
    across = x.join(y, apart & (estimate(F.col("x.sig"), F.col("y.sig")) >= percent / 100 - MARGIN)).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    more = confirmed(across, docs, width, percent)

    large = stored(mixed.where(F.col("n") > LARGE).select("bucket", "node", "component", stray.alias("stray"), "n", "strays"), "large")
    if not large.isEmpty():
        more = more.unionByName(block_links(large, sketches, docs, width, percent))
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    labels = stored(labels, "labels")
    out = rows.join(labels.withColumnRenamed("node", "_kv_node"), F.col("node") == F.col("_kv_node"), "left")
    component = F.coalesce("component", "node")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its group, with the columns of ``docs``."""
    gone = stored(near_duplicates(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias("_kv_gone")).distinct(), "gone")
    return docs.join(near(gone), F.col("doc_id") == F.col("_kv_gone"), "left_anti")


def op4_bbit_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=2, percent=80)


ORACLE_OP4 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM d WHERE len(w) > 0
), n AS (
  SELECT doc_id, len(g) AS n FROM s
), e AS (
  SELECT doc_id, unnest(g) AS g FROM s
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * n_both >= 80 * (na.n + nb.n - n_both)
), u AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS c FROM d
  UNION
  SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id WHERE r.c < u.b
), m AS (
  SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
