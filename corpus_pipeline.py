"""A corpus pipeline: quality, line dedup, near-dedup, mixing, tokens. Each stage works on what the one before kept.

Nulls, repeated doc_ids, ties and further columns are handled as the operator of the stage states; an empty table gives
none. Without labels to learn from every score is 0.5, and the classifier keeps all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import byte_bpe, line_dedup, mixing, quality_classifier, simhash_dedup
from lorespark.llm.common import Workspace, read
from lorespark.llm.queries import vocabulary

#: Trained scores, hashes and vocabularies have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects."""
    out = quality_classifier.classify(docs, read(spark, sf_dir, "labels"))
    return out.where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; n_chars follows the text. Documents that were lines repeated elsewhere alone are empty, and go."""
    out = line_dedup.dedup_lines(spark, docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.where("text <> '' OR n_dropped = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: a similarity of 0.8 or more of their shingles of five words."""
    return simhash_dedup.drop_duplicates(spark, docs, similarity=0.8).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights: a row per document and pass."""
    return mixing.mix(spark, docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document of the mix."""
    return byte_bpe.encode(docs, *vocabulary()).select("doc_id", "lang", "source", "bpe.n_tokens", "bpe.ids", "bpe.ids_sha256", "bpe.decoded_sha256")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("mixing to target weights", mixture), ("byte-level BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
