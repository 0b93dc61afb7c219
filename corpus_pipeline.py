"""A training-corpus pipeline: quality, line dedup, SimHash near-dedup, source mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on what the one before kept; all but the last return the columns
of documents (doc_id, text, lang, source, n_chars) under their names, and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscope.llm.common import save
from crawlscope.llm.line_dedup import dedup_lines
from crawlscope.llm.mixing import mix_sources
from crawlscope.llm.pieces import sample_pieces
from crawlscope.llm.quality import fit_quality, held_out, score_quality
from crawlscope.llm.simhash import dedup_near_copies

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents that score less are rejected.
MIN_QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that a model, fitted on the labelled ones outside the held-out fold, scores MIN_QUALITY or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    docs = docs.select(*COLUMNS)
    model = fit_quality(docs, labels, ~held_out())
    return score_quality(docs, model, score_col="quality_score").where(F.col("quality_score") >= MIN_QUALITY).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that other documents hold too; every document stays, if need be with an empty text."""
    out = dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that pairs at Jaccard 0.8 or more, over five-word shingles, connect."""
    return dedup_near_copies(docs.select(*COLUMNS)).select(*COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that all sources weigh the same, in a global shuffle."""
    return mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each document, as piece ids with their scores."""
    return sample_pieces(docs.select("doc_id", "text"), n_samples=2).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", mix_to_weights),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: Models, hashes and sampling over lattices are beyond SQL: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, f"pipeline-{k}")
    return docs
