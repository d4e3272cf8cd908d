"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again.

Every stage takes what its predecessor kept. All but the last return the columns of documents;
the last returns ids, their digests and the digest of the decoded text.

Other columns of documents are passed on up to the last stage; one that is named as a result of
a stage (kept, n_words, n_lines, n_hit, ...) holds that result afterwards. Null and empty
texts fail the quality rules, so the later stages see none but those that line dedup empties.
These have no words: near duplicates keeps them all, decontamination finds nothing in them and
they have the end id alone. Rows with a null or repeated doc_id are told apart by their texts;
of rows equal in both one stays. Texts are read whole, and empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontamination, line_dedup, ngram_jaccard, quality_rules, sentence_pieces
from granary.llm._store import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.assess(docs, labels, keep_text=True).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them hold; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least doc_id."""
    return ngram_jaccard.one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.contamination(docs, items).where(~F.col("contaminated")).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of ids and decoded text."""
    import public_tokenizers

    return sentence_pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", clean),
    ("SentencePiece encoding and decoding", pieces),
]

#: Near-duplicate components and the tokenizer are outside SQL; tests compare a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return docs
