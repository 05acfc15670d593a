"""Token counts through a digest cache.

A text is known by the digest of its content, a tokenizer by the digest of its file. Counts are
kept in a table keyed by both. A run joins its texts to the cache by digest, encodes each distinct
text that misses once, appends the new counts, and joins the counts back to all rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelvault.llm.common import documents, shared_folder, stored

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content(text: Column) -> Column:
    """Content normalised for the cache: null is the empty text. Nothing else is changed, because
    case, white space and Unicode forms all change the tokens."""
    return F.coalesce(text, F.lit(""))


def sentencepiece_counter(sent, memo_limit: int = 400_000):
    """text -> number of pieces, as a column function. ``sent`` holds the model's file, broadcast, so
    that executors need not see the driver's files.

    A piece never spans the start of a run of spaces if no piece of the model has a space mark
    after another character, which is checked on the model; then a text's count is the sum over
    its units (a run of spaces and what follows up to the next), and counts of short units are
    remembered in a memo of bounded size. For any other model whole texts are encoded."""

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import re

        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=sent.value)
        mark = "▁"
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        free = [p for i, p in enumerate(pieces) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        # The checks that make counting by unit exact: marks only lead, a space is a mark, and text is taken as it is.
        apart = not any(mark in p.lstrip(mark) for p in free)
        probe = "AaÉ  　x\t\n Ａé "
        apart = apart and model.decode(model.encode(probe)) == probe and model.encode("x", out_type=str)[:1] in ([mark + "x"], [mark])
        if not apart:
            for batch in batches:
                texts = [x or "" for x in batch.to_pylist()]
                yield pa.array([len(x) for x in model.encode(texts, num_threads=1)], pa.int64())
            return
        units = re.compile(f"[ {mark}]+[^ {mark}]*|[^ {mark}]+").findall
        encode = model.encode
        # Encoded alone, a unit gets a space mark before it, which stands for its first space.
        memo: dict[str, int] = {}

        def of(unit: str) -> int:
            n = memo.get(unit)
            if n is None:
                n = len(encode(unit[1:], num_threads=1)) if len(unit) > 1 else len(encode("x" + unit, num_threads=1)) - len(encode("x", num_threads=1))
                if len(unit) <= 32:
                    if len(memo) >= memo_limit:
                        memo.clear()
                    memo[unit] = n
            return n

        for batch in batches:
            out = []
            for value in batch:
                text = value.as_py()
                out.append(sum(map(of, units(" " + text))) if text else 0)  # the model marks the start of a text
            yield pa.array(out, pa.int64())

    return F.arrow_udf(count, "long").asNondeterministic()


def count_tokens(docs: DataFrame, cache_path: str, model_path: str) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens``; new counts are appended at ``cache_path``.

    Null texts count as empty: 0 bytes, 0 tokens. Equal texts are encoded once, whatever rows they
    are in and whatever their ids; rows that repeat or lack an id keep their own counts. Texts of any
    length are encoded whole. Columns of docs named n_bytes or n_tokens are replaced; an empty table
    gives an empty table. The cache may not exist yet. An entry that was appended twice (by runs at
    the same time) is read once."""
    spark = docs.sparkSession
    version = tokenizer_version(model_path)
    with open(model_path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    base = docs.drop("n_bytes", "n_tokens")
    text = content(F.col("text"))
    digested = base.withColumns({"_kv_digest": F.unhex(F.sha2(text, 256)), "n_bytes": F.octet_length(text).cast("long")})

    def cached() -> DataFrame:
        try:
            table = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            table = spark.createDataFrame([], CACHE_SCHEMA)
        known = table.where(F.col("tokenizer") == version).groupBy(F.col("digest").alias("_kv_cached")).agg(F.max("n_tokens").alias("_kv_tokens"))
        return stored(known, "known")  # so that a join with it is one that Spark can split where a text is frequent

    # One row stands for each distinct missing text: the digests decide which, without the texts.
    row = F.xxhash64("doc_id")
    missing = digested.groupBy("_kv_digest").agg(F.min(row).alias("_kv_row")).join(cached(), F.col("_kv_digest") == F.col("_kv_cached"), "left_anti")
    missing = stored(missing, "missing").withColumnsRenamed({"_kv_digest": "_kv_missing", "_kv_row": "_kv_first"})
    texts = digested.select("_kv_digest", row.alias("_kv_row"), text.alias("_kv_text"))
    texts = texts.join(missing, (F.col("_kv_row") == F.col("_kv_first")) & (F.col("_kv_digest") == F.col("_kv_missing")), "left_semi")
    # Rows with one id and one text are left: any of them will do.
    texts = texts.dropDuplicates(["_kv_row", "_kv_digest"])
    fresh = texts.select(F.lit(version).alias("tokenizer"), F.col("_kv_digest").alias("digest"), sentencepiece_counter(sent)("_kv_text").alias("n_tokens"))
    fresh.write.mode("append").parquet(cache_path)

    counts = cached()
    joined = digested.join(counts, F.col("_kv_digest") == F.col("_kv_cached"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in base.columns], "n_bytes", F.col("_kv_tokens").alias("n_tokens"))


def op7_token_cache(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cache = f"{shared_folder(spark)}/token_counts"
    counted = count_tokens(documents(spark, sf_dir).select("doc_id", "text"), cache, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
