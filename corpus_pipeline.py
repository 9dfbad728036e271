"""From documents to training text: line rules, quality, near duplicates, the mix, and pieces.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept, and all but the last return the columns of
documents. Rejected documents go; failing lines go; one document of each group of near duplicates (the smallest id) stays;
documents stand as often as the mix takes them. The last stage gives the n-best segmentation of every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terradelta.llm import line_rules, mil, mixing, parity_join, pieces
from terradelta.llm.common import documents, stored
from terradelta.llm.registry import labels, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_rules.cleaned_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mil.kept_documents(docs, labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return parity_join.one_per_component(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.segmented(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", piece_encoding),
]

ORACLE_SQL = None  # the classifier and the segmentation are beyond SQL; tests/llm/test_pipeline.py holds a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written below the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
