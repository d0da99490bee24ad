"""A corpus pipeline: language ID, line dedup, near-duplicate documents, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from arcwise.llm.byte_bpe import bpe_round_trip
from arcwise.llm.decontaminate import decontaminate
from arcwise.llm.jaccard_join import shingle_components
from arcwise.llm.language import UNKNOWN, held_out, identify, train
from arcwise.llm.line_dedup import drop_repeated_lines
from arcwise.llm.queries import RANKS
from arcwise.llm.shared import few_files, free_names, lookup, table, written

#: A document whose likeliest language is less likely than this is rejected.
MIN_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of which no language is likely."""
    found = identify(few_files(docs, docs), train(docs, ~held_out()))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that match an earlier one; documents of which no word is left go."""
    out = drop_repeated_lines(docs)
    out = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select([F.length("text").cast("bigint").alias(c) if c == "n_chars" else c for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of least id: five-word shingles, similarity 0.8 or more.

    Rows without id and rows that share one are told apart by their text; they stand behind the others of their group.
    """
    node, again, row = free_names(docs, "node", "again", "row")
    col = lambda c: F.col(f"`{c}`")
    columns = [col(c) for c in docs.columns]
    odd = written(docs.groupBy(col("doc_id").alias(node)).count().filter(f"count > 1 or {node} is null").select(node, F.lit(True).alias(again)), "again")
    if odd.isEmpty():
        groups = shingle_components(docs, size=5, share=80)
        gone = lookup(groups.filter("doc_id != component_id").select("doc_id").distinct(), F.lit(40))
        return docs.join(gone, "doc_id", "left_anti").select(columns).transform(few_files, docs)
    rows = docs.join(odd, F.col("doc_id").eqNullSafe(F.col(node)), "left").drop(node)
    own = (1 << 62) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 61))
    rows = rows.withColumn(node, F.when(col(again), own).otherwise(F.col("doc_id").cast("bigint")))
    groups = shingle_components(rows, doc=node, size=5, share=80)
    left = rows.join(groups.filter(col(node) != F.col("component_id")).select(node).distinct(), node, "left_anti")
    # Rows that repeat both id and text are one document; empty ones are in no group.
    wordy = F.coalesce(col(again) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = left.filter(wordy).groupBy(node).agg(F.first(F.struct(*columns)).alias(row)).select(f"{row}.*")
    return left.filter(~wordy).select(columns).unionByName(once).transform(few_files, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark windows in a twentieth of their words or more."""
    return decontaminate(few_files(docs, docs), table(spark, sf_dir, "benchmark")).filter("not contaminated").select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    out = bpe_round_trip(few_files(docs, docs).select("doc_id", "lang", "source", "text"), RANKS, public_tokenizers.PATTERN, keep_ids=True)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("byte-level BPE", byte_bpe)]

#: No SQL expresses a trained classifier or byte-pair merges; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage", 0)
    return docs
