"""A training-data pipeline over ``documents``: five stages, each one of the operators of relevara.llm.

Each stage takes what its predecessor kept, written as Parquet and read again; all but the last
return the columns of documents.  Nulls, empty and very long texts, ties, repeated rows, empty
tables and extra columns are handled as each operator's docstring defines; extra columns pass
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevara.llm.common import written
from relevara.llm.exact_dedup import exact_dedup, without_copies
from relevara.llm.language_id import identify
from relevara.llm.mixing import mix, remixed
from relevara.llm.ngram_jaccard import jaccard_components, one_of_each
from relevara.llm.packing import pack
from relevara.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have no language, a null text or no letter; a null ``lang`` becomes the language found.

    The languages are learned from the labels in ``docs``; without any label all texts with a
    letter stay as they are.
    """
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not docs.filter(F.col("lang").isNotNull() & has_letter).limit(1).count():
        return docs.filter(has_letter)
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    found = identify(spark, docs.select(row, "doc_id", "lang", "text"), F.lit(True), ["row"]).filter("lang_pred <> 'und'")
    col = lambda i, c: F.coalesce(F.col(f"row.c{i}"), F.col("lang_pred")) if c == "lang" else F.col(f"row.c{i}")
    return found.select(*[col(i, c).alias(c) for i, c in enumerate(docs.columns)])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space apart: the longest, then the smallest doc_id."""
    return without_copies(spark, docs, written(spark, exact_dedup(spark, docs)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return one_of_each(spark, docs, written(spark, jaccard_components(spark, docs, size=5, num=80, den=100)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return remixed(spark, docs, written(spark, mix(spark, docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024: one row for each piece, with its ids and its place."""
    return pack(spark, docs, vocabulary(), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("source_mixing", mixing),
    ("best_fit_packing", packing),
]

#: SQL can express neither the automata of the first stage nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir))
    return docs
