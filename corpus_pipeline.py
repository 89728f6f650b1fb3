"""A corpus pipeline of five stages over ``documents``: quality rules, near-duplicates, surrogates
for personal data, mixing to target weights, and SentencePiece encoding.

Each stage takes ``(spark, docs, sf_dir)``; what it returns is written as Parquet and read
again as the next stage's ``docs``, so a lost executor never reaches back over a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkeda.llm import mixing, pieces, quality, simhash, surrogates
from sparkeda.llm.common import table, written
from sparkeda.llm.queries import run_key, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the smallest id."""
    return simhash.one_of_each(docs, shingle=3, distance=2)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and credentials get surrogates."""
    return surrogates.replace(docs, run_key(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their targets."""
    return mixing.apply_mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, token_ids``."""
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"), keep=["doc_id", "lang", "source"])


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
          ("mix_sources", mix_sources), ("encode_pieces", encode_pieces)]

#: Fingerprints, keyed draws and rounding have no SQL; tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
