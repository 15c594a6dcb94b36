"""A training-corpus pipeline: five stages, each one an operator of tidelens.llm over all that its predecessor kept.

run() writes each stage's rows to the shared folder once and reads them again, so no stage is computed twice. All stages but the last return the
columns of docs under their names, whatever these are, with the values they had; only substring_dedup changes text and n_chars.

Defined cases, for every stage: an empty table gives an empty one. A null text is no language's and goes in the first stage; alone, the later stages
treat it as an empty text, which fails the base rules, has fingerprint zero, has nothing to cut, and packs as the end id alone. Rows with a null
doc_id are judged like others, but near-dedup keeps them and substring dedup neither cuts them nor cuts others for them. Repeated rows
are rows of their own, of which near-dedup keeps one. Very long texts are never cut into prefixes; each is held in memory whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.llm import language, packing, quality, simhash
from tidelens.llm._spark import saved
from tidelens.llm.queries import END_ID, TOKENIZER
from tidelens.llm.substring_dedup import cut_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in a language that isn't known with a probability of one half, go. Without labels to learn from, only the former go."""
    return language.keep_known(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules fail, or that are rather not clean by the weighed votes, go."""
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints stays: the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in earlier documents are cut out; n_chars follows the text."""
    return cut_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences that training reads: which piece of which document stands where."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither training nor packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = saved(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
