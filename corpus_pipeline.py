"""A cleaning pipeline over ``documents``: language, line chunks, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs. All but
the last return the columns of docs. Null, empty and repeated rows, ties, empty tables and further columns are handled as the operators'
docstrings say; texts that are null or without letters go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import jaccard_join, language_id, queries
from loomwork.llm.decontamination import decontaminate
from loomwork.llm.line_dedup import without_passages
from loomwork.llm.packing import pack
from loomwork.llm.shared import bounded, saved, table, unused


#: Languages that are kept, None for all that documents are labelled with, and the least proportion of the text that has to be in one.
WANTED: tuple[str, ...] | None = None
LEAST_SHARE = 0.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known (and wanted) language. The model learns from the rows of ``docs`` that have a language; rejected are texts without
    letters, and those that fit the best language worse than labelled texts do. When no row has a language nothing is learned, and nothing
    is rejected."""
    model = language_id.train(docs)
    return language_id.in_known_language(docs, model, WANTED, LEAST_SHARE) if model.langs else docs


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of two or more lines, and the long lines, that an earlier document, or place, has. Documents of which nothing
    is left go, as do repeated rows. Documents that would lose four fifths of their words or more, but not all, are left to the next stage,
    which judges documents as a whole."""
    return without_passages(docs, jaccard_join.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    g_id, g_md5 = unused(docs, "g_id", "g_md5")
    found = saved(decontaminate(docs, table(spark, sf_dir, "benchmark"), null_ids=True).where("contaminated").select(F.col("doc_id").alias(g_id), F.col("text_md5").alias(g_md5)).distinct(), "contaminated")
    md5 = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return docs.join(bounded(found), F.col("doc_id").cast("long").eqNullSafe(F.col(g_id)) & (md5 == F.col(g_md5)), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2048 tokens."""
    return pack(docs, queries.tokenizer_path())


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: SQL can express neither the language model nor the signatures' hashes nor the packing plan; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
