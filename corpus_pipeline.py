"""From raw documents to shards of training data, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps; its result is
written as Parquet and read again as the next stage's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelvault.llm import decontaminate, mixing, neardup, sharding, toxicity
from keelvault.llm.common import documents, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labels of ``docs``, doesn't score as toxic.

    Null and empty texts stay, and whole texts are scored whatever their length. Rows are judged one by
    one by their texts, so equal rows stay or go together. Without labels nothing goes; an empty table
    gives an empty table; further columns stay as they are."""
    network = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, network)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more.

    First is the smallest doc_id; rows that repeat it all stay, as do rows without an id and documents
    without words. Texts are compared as a whole; an empty table gives an empty table; further columns
    stay as they are."""
    return neardup.deduplicate(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a window of a benchmark item.

    Null and empty texts stay; rows are judged one by one, whatever their ids and length. With an empty
    benchmark all stay; an empty table gives an empty table; further columns stay as they are."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: once for each epoch that it is in, or not at all.

    Documents with null, empty or blank texts are taken by the epochs of their source as well; a null
    source is one of its own. Equal rows are taken one by one. An empty table gives an empty table;
    further columns stay as they are."""
    return mixing.repeated(docs)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A uniform shuffle into eight shards of equal size, with each row's shard and slot.

    Nulls are values like any other and equal rows are rows of their own. Columns shard and slot are
    replaced, all others stay. An empty table gives an empty table."""
    return sharding.shuffle_to_shards(docs, shards=8)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", to_shards),
]

#: No stage before the second can be stated in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
