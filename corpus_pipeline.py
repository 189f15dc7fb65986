"""From raw documents to token ids, in five stages of the training-data operators.

Each stage reads all that the one before has kept. run() writes every stage's result as Parquet
in the shared folder and reads it again, so a lost executor costs no finished stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import jaccard_join, kneser_ney, mixing, quality_rules, sentence_pieces
from tessel.llm.scratch import collect_heaps, save


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are mostly labelled content; the labelled ones among docs train the labeller."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep(docs, quality_rules.train(docs, labels))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fitted = kneser_ney.fit(docs, labels)
    out = kneser_ney.keep(docs, fitted)
    if fitted is not None:
        fitted.drop()
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs, 5, 80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target weights, in a global random order."""
    out = mixing.replicate(docs)
    return out.drop(*out.columns[len(docs.columns) :])


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document."""
    encoded = sentence_pieces.encode(docs, sentence_pieces.read_model())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _rested(stage: Stage) -> Stage:
    """stage, before which executors give back the memory that the one before took."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_heaps(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", _rested(rules)),
    ("quality classifier", _rested(classifier)),
    ("n-gram Jaccard join", _rested(near_duplicates)),
    ("mixing sources", _rested(mixture)),
    ("SentencePiece encoding", _rested(pieces)),
]

#: The trained models have no SQL form; tests compare each stage with a plain one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for all documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = save(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
