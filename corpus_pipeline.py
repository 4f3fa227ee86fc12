"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and hands it, reread, to the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lattica.llm import bpefst, jaccard, langid, linedel, mixing
from lattica.llm.common import cut

#: Documents whose language is less certain than this go, as do those without a letter.
LEAST_CERTAIN = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; the model learns from the labels of this stage's input."""
    found = langid.identify(docs, langid.fit(docs))
    return found.where(f"lang_pred != '{langid.UNKNOWN}' and score >= {LEAST_CERTAIN}").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier in the corpus; those that lose all their lines go.

    n_chars stays what it was in the table."""
    return linedel.dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more, or that a chain of such pairs connects.

    SimHash links within 4 bits miss nearly all pairs near 0.8, so operator 10's exact search completes them."""
    return jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what was encoded and decoded.

    The codec's tables are small, since other stages run in the same worker processes."""
    return bpefst.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, memory=0.25)


STAGES = [("language ID", language), ("line dedup", line_dedup), ("SimHash near-dedup", near_duplicates), ("mixing", mix), ("byte-level BPE", encode)]

#: Trained models, hashes and tokenizers are beyond SQL: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
