"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of documents. Stages are written and reread by the caller, or run in one go by ``run``, which writes each
stage's rows into the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import common, decontam, ngram_jaccard, pii, spm, toxicity

#: Scores from here on reject a document.
TOXIC_FROM = 0.3
#: Word shingles and similarity of near duplicates and of benchmark passages.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
DROPOUT = 0.1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; rows with a null id are scored like all others."""
    lexicon = toxicity.fit(toxicity.labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.keep_below(docs, lexicon, TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by similar shingle sets, that with the smallest id, and all rows without words. Rows
    that repeat an id or have none are compared like all others."""
    return ngram_jaccard.keep_first(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without a passage of the benchmark; each is judged by its text alone."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), SHINGLE_WORDS, SIMILARITY_PERCENT / 100)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars counts the new text and is null for a null text."""
    out = pii.redact(docs, pii.fit(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every document."""
    import public_tokenizers

    out = spm.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"), dropout=DROPOUT)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("personal_data", redact_private),
    ("token_ids", encode_tokens),
]

#: Classifiers, similarity groups and merge agendas aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
