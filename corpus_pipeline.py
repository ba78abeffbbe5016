"""From raw documents to token ids, in five stages.

Each stage reads the Parquet that the one before wrote; all but the last return
the columns of ``documents``. ``run`` applies them one after another.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, jaccard_join, line_dedup, mixing, quality
from tracewell.llm.common import documents, written
from tracewell.llm.queries import DOMAIN, MIX_SEED, MIX_WEIGHTS, vocabulary

# Of the tokens that reach the mixing, so many are taken, none of them twice.
MIX_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return quality.judged(docs, name="__judged").where("__judged.kept").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in one of them; n_chars follows the text."""
    return line_dedup.without_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of similar ones, that of the least id.

    Rows without an id take part and come after the others. Of equal rows, those of one
    id (or none) and one text, one stays; different texts of one id are one document.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("row"), jaccard_join.key_of("doc_id", "text").alias("key"))
    groups = jaccard_join.similar_keys(docs).where("key = first").select("key")
    rows = keyed.join(groups, "key", "left_semi")
    again = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "again")
    # Only keys of several rows are grouped, so the other texts are not shuffled for this.
    several = rows.join(again, "key", "left_semi").groupBy("key", F.xxhash64(F.coalesce("row.text", F.lit("")))).agg(F.min("row").alias("row"))
    return rows.join(again, "key", "left_anti").select("row.*").union(several.select("row.*"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents beyond the budget of their domain, language and source go."""
    levels = [F.expr(DOMAIN), F.col("lang"), F.col("source")]
    mix = mixing.mixed(docs, levels, MIX_WEIGHTS, MIX_PERCENT, name="__mix", max_epochs=1, seed=MIX_SEED)
    return mix.where("__mix.copies > 0").select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of what they decode to."""
    texts = docs.select("doc_id", "text")
    out = bpe.digests(bpe.encoded_and_decoded(texts, vocabulary(), public_tokenizers.PATTERN, keep_text=False))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("source mixing", mixing_stage),
    ("byte-level BPE", bpe_stage),
]

# PartEnum and BPE are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
