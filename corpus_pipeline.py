"""The corpus pipeline: toxicity, SimHash near duplicates, exact repeats, benchmark contamination, BPE encoding.

Each stage works on all its predecessor kept, stored as Parquet in between; all but the last return the columns of
``documents``.  Extra columns of the input are not carried.  Rows of one doc_id are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm import op04_toxicity, op05_positional_index, op07_radix_dedup, op09_simhash_trie, op10_bpe_tree
from tallyloom.llm.common import importable, stored, table

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*DOCUMENT_COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the cutoff; a null or empty text scores low and stays."""
    model = op04_toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = op04_toxicity.score(docs, model, keep=("lang", "source", "n_chars", "text"))
    return _documents(scored.where(F.col("score") < op04_toxicity.CUTOFF))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash component; documents with a null id stay, as nothing names them."""
    importable(spark)
    groups = op09_simhash_trie.near_duplicates(docs)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return _documents(docs.join(gone, "doc_id", "left_anti"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that also start earlier; what a cut leaves of a character goes, too.

    Every document stays, if only with an empty text; n_chars counts the characters that are left.
    """
    importable(spark)
    kept = op07_radix_dedup.remove_repeats(docs, keep=("lang", "source"), as_text=True)
    return _documents(kept.withColumnRenamed("kept", "text").withColumn("n_chars", F.length("text").cast("bigint")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves alone."""
    rule = op05_positional_index.contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = rule.where("contaminated").select("doc_id").distinct()
    return _documents(docs.join(gone, "doc_id", "left_anti"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the byte-level BPE ids of what is left, and of the bytes they decode to."""
    importable(spark)
    return op10_bpe_tree.digests(op10_bpe_tree.encode_decode(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_duplicates", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: No SQL states a trained classifier, a fingerprint's components or a tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(table(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
