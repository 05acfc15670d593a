"""N-gram Jaccard join by grouped prefixes, exact: documents linked by the similarity of their shingle sets.

1. Shingles are put into one order for all documents: by how full their cell is, then by hash. A
   cell holds the shingles of one range of hashes; the documents of each are counted over the whole
   corpus, in an array of fixed size. So what many documents share comes last.
2. The prefix of a set of n shingles is its first n - ceil(limit * n) + 1: sets that are linked
   share a shingle of their prefixes. Equal sets are one class; classes with the same prefix and
   size are one group, known by its smallest member. Only groups meet in buckets, one a shingle.
3. In each bucket every group is paired with the smallest one, so pairs are linear in the bucket; in
   large buckets once more with the member that lies in the largest ones. Pairs pass the filters of
   size and of parity bits and are then verified on the whole sets; connected components follow.
4. Groups are expanded where a bucket still holds several components: members outside the largest
   one are held against those of other components and of a fitting size and place, under the same
   filters. So no pair of a bucket stays unseen unless its ends are connected already.

The filters lose nothing. Sizes of linked sets differ by the limit at most. The first shingle that two
linked sets share has as many shingles behind it, in both, as the link needs. Parity bits are one bit
a cell of hashes, the parity of the set's shingles there; each bit in which two sets differ needs a
shingle of only one of them. Sets are held as 64-bit hashes: a link is wrong only where two shingles
of one pair collide, with a chance below 1e-10 for texts of 10,000 words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelvault.llm.common import documents, stored
from keelvault.llm.neardup import components, near

#: 2 ** CELL_BITS cells order the shingles (4 MB where they are broadcast), counted in so many ranges.
CELL_BITS, RANGE_BITS = 22, 10
#: Parity bits of a set, in longs.
PARITY_LONGS = 16
#: Buckets of more members are large: their groups are paired a second time, and pairs pass the parity bits
#: in the join itself, where a stray meets so many members of one size in one place.
LARGE, BLOCK = 64, 512

SKETCH = T.StructType([T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("grp", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType()))])


def shingler(width: int):
    """text -> sorted hashes of its distinct ``width``-word shingles; of fewer words, of all of them as one."""
    import xxhash

    mix = np.random.default_rng(11).integers(0, 2**64, width, dtype=np.uint64) | np.uint64(1)

    def shingles(text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        if not len(h):
            return h
        n = max(1, len(h) - width + 1)
        x = np.full(n, min(len(h), width), np.uint64)
        for i in range(min(width, len(h))):
            x = (x ^ (x >> np.uint64(29))) * mix[i] + h[i : i + n]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(x ^ (x >> np.uint64(32)))

    return shingles


def cell_counts(texts: DataFrame, width: int) -> np.ndarray:
    """Documents with a shingle in each cell, over all texts: each task counts its own, ranges of cells are
    added up as they stream by, and the sums, of fixed size, come to the driver."""
    cells, ranges = 2**CELL_BITS, 2**RANGE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shingler(width), np.zeros(cells, np.uint32)
        for batch in batches:
            for text in batch.column(0):
                total[(own(text.as_py()) >> np.uint64(64 - CELL_BITS)).astype(np.int64)] += 1
        narrow = np.min_scalar_type(total.max())
        held = [(i, part.astype(narrow)) for i, part in enumerate(total.reshape(ranges, -1)) if part.any()]
        for i in range(0, len(held), 64):
            some = held[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([x.tobytes() for _, x in some], pa.binary())], ["cells", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(x.as_py(), f"u{len(x.as_py()) * ranges // cells}")
                sums[k] = sums[k] + part if k in sums else part.astype(np.int64)
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["cells", "counts"])

    schema = "cells int, counts binary"
    out = np.zeros((ranges, cells // ranges), np.int64)
    for r in texts.select("text").mapInArrow(count, schema).repartition("cells").mapInArrow(add, schema).toLocalIterator():
        out[r["cells"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


def fullness(counts: np.ndarray) -> np.ndarray:
    """Of each cell which of 256 classes of about equal numbers of cells, from empty to full, it is in."""
    edges = np.unique(np.quantile(counts, np.arange(1, 256) / 256, method="higher"))
    return np.searchsorted(edges, counts, side="left").astype(np.uint8)


def sketcher(width: int, percent: int, sent):
    """text -> SKETCH as a column function; ``sent`` holds the cells' classes, broadcast."""
    longs = PARITY_LONGS

    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        own, full = shingler(width), sent.value
        for batch in batches:
            counts, digests, groups, prefixes, parities, ends, whole = [], [], [], [], [], [0], [0]
            for value in batch:
                x = own(value.as_py())
                n = len(x)
                counts.append(n)
                if not n:
                    digests.append(None)
                    groups.append(None)
                    ends.append(ends[-1])
                    whole.append(whole[-1])
                    continue
                k = n + (-percent * n) // 100 + 1  # n - ceil(percent * n / 100) + 1
                # A shingle is named by its class and the upper bits of its hash, which is its place in the order.
                place = (full[(x >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (x >> np.uint64(8))
                prefix = np.sort(np.partition(place, k - 1)[:k] if k < n else place)
                flags = np.bincount((x & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
                digests.append(xxhash.xxh3_128_digest(x.tobytes()))
                groups.append(xxhash.xxh3_128_digest(n.to_bytes(8, "little") + prefix.tobytes()))
                prefixes.append(prefix)
                parities.append(np.packbits(flags.astype(np.uint8)).view(np.int64))
                ends.append(ends[-1] + k)
                whole.append(whole[-1] + longs)

            def lists(parts, at):
                flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
                return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int64()))

            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(groups, pa.binary()), lists(prefixes, ends), lists(parities, whole)], names=["n", "digest", "grp", "prefix", "bits"])

    return F.arrow_udf(sketch, SKETCH).asNondeterministic()


def hashed_sets(width: int):
    """text -> hashes of its shingles, as a column function."""

    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shingler(width)
        for batch in batches:
            sets = [own(x.as_py()).view(np.int64) for x in batch]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64), pa.int64()))

    return F.arrow_udf(column, "array<bigint>").asNondeterministic()


def may_link(one: str, other: str, percent: int) -> Column:
    """Whether two sets (columns <name>.n, <name>.bits) can be linked, by their sizes and parity bits."""
    n, m = F.col(f"{one}.n"), F.col(f"{other}.n")
    apart = F.lit(0)
    for i in range(PARITY_LONGS):
        apart = apart + F.bit_count(F.get(F.col(f"{one}.bits"), F.lit(i)).bitwiseXOR(F.get(F.col(f"{other}.bits"), F.lit(i))))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * apart <= (100 - percent) * (n + m))


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of class ids those whose whole sets are linked."""
    likely = stored(pairs.select("a", "b").distinct(), "likely")
    wanted = near(stored(likely.select(F.explode(F.array("a", "b")).alias("_kv_node")).distinct(), "wanted"))
    sets = docs.join(wanted, F.col("doc_id") == F.col("_kv_node"), "left_semi").select(F.col("doc_id").alias("node"), hashed_sets(width)("text").alias("s"))
    sets = stored(sets, "sets")
    met = likely.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    both = met.select("a", "b", F.size("sa").alias("n"), F.size("sb").alias("m"), F.size(F.array_intersect("sa", "sb")).alias("k"))
    return stored(both.where((F.col("k") > 0) & (100 * F.col("k") >= percent * (F.col("n") + F.col("m") - F.col("k")))).select("a", "b").distinct(), "links")


def likely_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class ids that the filters leave."""
    own = classes.select("node", F.struct("n", "bits").alias("x"))
    met = pairs.select("a", "b").distinct().join(own.select(F.col("node").alias("a"), F.col("x").alias("xa")), "a").join(own.select(F.col("node").alias("b"), F.col("x").alias("xb")), "b")
    return met.where(may_link("xa", "xb", percent)).select("a", "b")


def star_links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links among the pairs (a, b) of class ids, by the filters and then by the sets."""
    return verified(likely_pairs(pairs, classes, percent), docs, width, percent)


def size_class(percent: int) -> Column:
    """Classes of sizes of which linked sets lie in one, or in two that follow each other."""
    return F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")


def shared_buckets(spread: DataFrame, percent: int) -> DataFrame:
    """(bucket, head, at, leader) of the buckets of several groups, with the smallest group of each.

    Most have two. There each of the two knows the other by what both together leave when its own size and
    place are taken out, so pairs that can't start in such a bucket go before anything is made of them."""
    own = F.shiftleft("n", 31).bitwiseOR(F.col("at"))
    buckets = spread.groupBy("bucket").agg(F.count("*").alias("k"), F.bit_xor(own).alias("both")).where("k > 1")
    met = spread.join(stored(buckets, "buckets"), "bucket").withColumn("other", F.col("both").bitwiseXOR(own))
    met = met.select("bucket", "head", "at", "k", F.struct("n", "at").alias("x"), F.struct(F.shiftright("other", 31).alias("n"), F.col("other").bitwiseAND(2**31 - 1).alias("at")).alias("y"))
    members = stored(met.where((F.col("k") > 2) | may_start("x", "y", percent)).select("bucket", "head", "at"), "members")
    leaders = members.groupBy("bucket").agg(F.min("head").alias("leader"), F.max("head").alias("_kv_last")).where("leader <> _kv_last").drop("_kv_last")
    return stored(members.join(leaders, "bucket"), "shared")


def mixed_buckets(members: DataFrame, heads: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, at, n, component, k, stray): the expanded members of buckets that hold several components.

    ``members`` has the groups of each bucket and the shingle's place in their prefixes (bucket, head,
    at), ``heads`` the group and size of each class (node, head, n). A group of several classes is a
    bucket of its own as well."""
    told = heads.join(labels, "node", "left").select("node", "head", "n", F.coalesce("component", "node").alias("component"))
    spans = told.groupBy("head").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("k"))
    alone = spans.where("k > 1 AND lo <> hi").select(F.xxhash64(F.lit("group"), "head").alias("bucket"), "head")
    across = members.join(spans, "head").groupBy("bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("bucket")
    rows = members.select("bucket", "head", "at").join(across, "bucket", "left_semi").unionByName(alone.withColumn("at", F.lit(0)))
    full = stored(rows.join(told, "head").select("bucket", "node", "at", "n", "component"), "expanded")
    sizes = full.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    major = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("k", "component")).alias("major"), F.sum("k").alias("k"))
    return stored(full.join(major, "bucket").select("bucket", "node", "at", "n", "component", "k", (F.col("component") != F.col("major")).alias("stray")), "mixed")


def may_start(one: str, other: str, percent: int) -> Column:
    """Whether two linked sets can have this bucket's shingle (place <name>.at of the order) as the first that
    they share: from there on both must have as many shingles as a link needs."""
    n, m = F.col(f"{one}.n"), F.col(f"{other}.n")
    rest = F.least(n - F.col(f"{one}.at"), m - F.col(f"{other}.at"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * rest >= percent * (n + m))


def stray_links(mixed: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between strays of a bucket and its members of other components.

    Members of small buckets meet by id, and pairs that are left meet their parity bits. Those of large ones
    meet by bucket, class of size and block of members, so a large bucket is many small keys."""
    few = mixed.where(F.col("k") <= LARGE)
    x, y = few.where("stray").alias("x"), few.alias("y")
    here = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") != F.col("y.component")) & may_start("x", "y", percent)
    small = x.join(y, here).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    small = likely_pairs(small, classes, percent)
    full = mixed.where(F.col("k") > LARGE).join(classes.select(F.col("node").alias("_kv_node"), F.col("n").alias("_kv_n"), "bits"), (F.col("node") == F.col("_kv_node")) & (F.col("n") == F.col("_kv_n")))
    full = stored(full.select("bucket", size_class(percent).alias("size"), "node", "component", "stray", "at", "n", "bits"), "sized")
    held = full.groupBy("bucket", "size").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    other = full.join(held, ["bucket", "size"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).alias("y")
    looks = full.where("stray").select("bucket", "node", "component", "at", "n", "bits", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"))
    looks = looks.join(held, ["bucket", "size"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("x")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("bucket", "size", "block")]
    apart = F.col("x.component") != F.col("y.component")
    met = looks.join(other, same[0] & same[1] & same[2] & apart & may_start("x", "y", percent) & may_link("x", "y", percent))
    met = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    return verified(small.unionByName(met), docs, width, percent)


def prefix_join(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text, ...).

    Words are lower-cased (A-Z) runs without white space; a text of fewer than ``width`` words is one
    shingle. Documents link when 100 * intersection >= ``percent`` * union; component_id is the
    smallest doc_id that links reach. Null texts and texts without words have no shingles and link
    with nothing. Rows that repeat a doc_id are one document: a link of either is a link of both. A
    row with a null doc_id has a null component_id and links with nothing. An empty table gives an
    empty table. Texts of any length are read whole. Other columns are not read, so their names
    don't matter."""
    docs = docs.select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(fullness(cell_counts(docs, width)))
    made = stored(docs.select("doc_id", sketcher(width, percent, sent)("text").alias("s")).select("doc_id", "s.*"), "sketches")
    named = made.where("n > 0 AND doc_id IS NOT NULL")
    shared = named.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")).where("copies > 1")
    shared = near(stored(shared.select(F.col("digest").alias("_kv_digest"), "node"), "shared"))
    met = made.join(shared, F.col("digest") == F.col("_kv_digest"), "left")
    node = F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id"))
    rows = stored(met.select("doc_id", "n", "digest", node.alias("node")), "rows")
    sketched = met.where("n > 0 AND doc_id IS NOT NULL")
    classes = sketched.where("node IS NULL").unionByName(sketched.where("node = doc_id").dropDuplicates(["doc_id", "digest"]))
    classes = stored(classes.select(F.col("doc_id").alias("node"), "n", "grp", "prefix", "bits"), "classes")
    # Rows with one id but several sets tie the classes of these together.
    torn = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select(F.col("doc_id").alias("_kv_id"))
    own = rows.join(near(stored(torn, "torn")), F.col("doc_id") == F.col("_kv_id"), "left_semi").where("n > 0 AND node <> doc_id")
    own = stored(own.select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct(), "own")

    groups = classes.groupBy("grp").agg(F.min("node").alias("head"), F.count("*").alias("k")).where("k > 1").select("grp", "head")
    heads = classes.join(near(stored(groups, "groups")), "grp", "left").select("node", F.coalesce("head", "node").alias("head"), "prefix", "n")
    heads = stored(heads, "heads")
    members = shared_buckets(heads.where("node = head").select("head", "n", F.posexplode("prefix").alias("at", "bucket")), percent)
    heads = heads.select("node", "head", "n")

    first = members.where("head <> leader").select(F.col("leader").alias("a"), F.col("head").alias("b"))
    first = first.unionByName(heads.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")))
    links = own.unionByName(star_links(first, classes, docs, width, percent))
    labels = components(links)

    mixed = mixed_buckets(members, heads, labels)
    large = mixed.where(F.col("k") > LARGE)
    middle = large.groupBy("node").agg(F.sum("k").alias("weight"))
    middles = large.join(middle, "node").groupBy("bucket").agg(F.max_by(F.struct("node", "component"), F.struct("weight", "node")).alias("x"))
    again = large.join(middles, "bucket").where("component <> x.component").select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b"))
    more = star_links(again, classes, docs, width, percent)
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
        mixed = mixed_buckets(members, heads, labels)
    more = stray_links(mixed, classes, docs, width, percent)
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    labels = stored(labels.withColumnRenamed("node", "_kv_node"), "labels")
    out = rows.join(labels, F.col("node") == F.col("_kv_node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def op11_prefix_join(spark, sf_dir: str) -> DataFrame:
    return prefix_join(documents(spark, sf_dir), width=4, percent=85)


ORACLE_OP11 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3])) ELSE [array_to_string(w, ' ')] END) AS g FROM d WHERE len(w) > 0
), n AS (
  SELECT doc_id, len(g) AS n FROM s
), e AS (
  SELECT doc_id, unnest(g) AS g FROM s
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * n_both >= 85 * (na.n + nb.n - n_both)
), u AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS c FROM d
  UNION
  SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id WHERE r.c < u.b
), m AS (
  SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
