"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage but the last keeps the columns of ``documents``, whatever their names and number. SQL cannot express
the stages, so there is no oracle; tests hold each one against a brute-force version on small tables.

Defined cases: null and empty texts, and texts without a letter, have no language and go in the first stage, as do
all rows where there is no language to learn; of rows equal in id and text one stays; rows with a null id take part
in the first two stages and in the last, and pass the third and the fourth as they are, as these decide by id;
texts of any length are read whole; empty tables give empty results, and an empty benchmark rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import bpe, decontam, langid, minhash, substring
from tidegrid.llm.queries import learnable_languages, table, vocabulary_path
from tidegrid.llm.shared import saved

#: A document is rejected if its language is unknown or less likely than this.
LEAST_LANGUAGE_SCORE = 0.3
#: Up to so many ids (8 bytes each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without an identifiable language."""
    model = langid.train(learnable_languages(docs))
    predicted = langid.predict(docs, model, keep=tuple(F.col(c) for c in docs.columns))
    named = predicted.toDF(*(f"c{i}" for i in range(len(docs.columns))), "lang_pred", "lang_score")
    kept = named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies."""
    return minhash.deduplicated(docs, threshold=0.8, width=5)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that repeat a passage of an earlier document; n_chars follows the text."""
    passages = saved(substring.repeated_passages(docs, threshold=0.8, least_words=6, run_words=20))
    out = substring.without_passages(docs, passages)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold half of a benchmark item or more."""
    found = saved(decontam.contaminated(docs, table(spark, sf_dir, "benchmark"), least_match=5, threshold=0.5).select("doc_id").distinct())
    return docs.join(F.broadcast(found) if found.count() <= BROADCAST_IDS else found, "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left."""
    return bpe.round_trip(docs, vocabulary_path())


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
