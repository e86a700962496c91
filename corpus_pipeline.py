"""A corpus from raw documents: quality, exact dedup, near dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of documents.  Rows with null texts count as empty
texts, an empty table passes through, and further columns of docs are handed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate, exact_dedup, ngram_join, piece_lattice, quality
from lodestrata.llm.common import crc_mod, fresh, materialise, read_table
from lodestrata.llm.queries import tokenizer

#: Documents of a lower score than this go.
MIN_QUALITY = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from three quarters of the labels."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), ~crc_mod("doc_id", 4).eqNullSafe(2))
    name = fresh("_quality", docs)  # docs may have a score of its own
    return quality.score(docs, model, name).where(F.col(name) >= MIN_QUALITY).select(docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact_dedup.exact_dedup_rows(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id."""
    return ngram_join.ngram_join_rows(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate_rows(docs, read_table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and whether decoding gives the text back."""
    return piece_lattice.encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding", encode_stage),
]

#: Classifier scores, sampled tokens and merges can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return docs
