"""From raw documents to a sharded training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and works on every document its predecessor kept: poor documents go, one
document of each near-duplicate class stays, documents with benchmark passages go, sources are mixed to their target
weights (documents of sources with a high target repeat), and the rows are dealt to shards.

In every stage null ids, texts, languages and sources are ordinary values, null and empty texts alike count as texts
without words, texts of any length are read whole, repeated rows are treated alike, an empty table gives an empty result, and further columns, whatever
their names (save those that begin with ``__tw_``), are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.decontamination import drop_contaminated
from tracewell.llm.mixing import mix_sources, take_mix
from tracewell.llm.near_duplicates import drop_near_duplicates
from tracewell.llm.quality_classifier import LEAST_SCORE, learn_quality, score_quality, training_labels
from tracewell.llm.sharding import shard_rows
from tracewell.session import materialize

SHARDS = 40


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of ids whose checksum is not 0 mod 5; documents that score below 0.3 go.

    Null and empty texts get one and the same score, and are kept or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = learn_quality(docs, training_labels(labels))
    return score_quality(docs, model, "__tw_score").filter(F.col("__tw_score") >= LEAST_SCORE).select(_own(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class stays (nulls last); rows equal in every column are one document.

    Texts without words are one class.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item, or a whole shorter item, go.

    Texts without words stay.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1, repeating; a document comes as often as the mix takes it, three times at most.

    Null sources are one source, the last. Of rows equal in id, text and source as many are taken as the budget has room for.
    """
    return take_mix(mix_sources(docs))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds row_number, shard (0 to 39) and slot; columns that have these names are replaced."""
    return shard_rows(docs, SHARDS)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A fitted classifier and fingerprints of XXH64 are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
