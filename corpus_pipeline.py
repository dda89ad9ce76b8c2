"""A corpus pipeline of five stages over ``documents``.

Each stage takes the documents its predecessor kept and returns documents; the
last one adds what each gives to the mix.  ``run`` writes every stage as Parquet
to a new folder in the shared one and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.llm import decontaminate, jaccard, mixing, secrets, toxicity
from dqspark.llm.common import read, small_batches, store

#: Rows of ids up to which a list of rejected documents is sent to all tasks.
BROADCAST_IDS = 200_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is not listed; those without an id stay."""
    held = store(ids)
    held = F.broadcast(held) if held.count() <= BROADCAST_IDS else held
    return docs.join(held, "doc_id", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; learned from the labels of the rows that came in."""
    small_batches(spark)
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    score = toxicity.score_column(docs, model)
    return docs.where(score < 0.5)


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of similar ones; of rows that share an id, all or none."""
    classes = jaccard.similar_documents(docs)
    return _without(docs, classes.where("doc_id <> component_id").select("doc_id").distinct())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    found = decontaminate.find_contamination(docs, read(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("n_hit > 0 AND doc_id IS NOT NULL").select("doc_id").distinct())


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced in the text and n_chars counted anew where it changed."""
    small_batches(spark)
    clean = docs.withColumn("text", secrets.redacted(F.col("text")))
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with the words each gives (``taken``), its size and its source's target; others go."""
    mixed = mixing.mix_sources(docs).where("taken > 0")
    return mixed.select("doc_id", "source", "size", F.col("source_size").cast("long"), "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_alike),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: The character model and the lexer have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents of a directory."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
