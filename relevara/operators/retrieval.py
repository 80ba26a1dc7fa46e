"""BM25 retrieval: statistics of terms by shuffles, scores by a join on the query's terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relevara.functions.scalars import tokens

K1, B = 1.5, 0.75
#: Times that a title counts.
TITLE = 3
#: Copies of the postings of one term's queries: a term that many queries ask for meets its postings in so many tasks.
SALTS = 16


def product_text(title: Column, *others: Column) -> Column:
    """What is searched: the title ``TITLE`` times, then the other fields."""
    return F.concat_ws(" ", *[title] * TITLE, *others)


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, dl, term, tf) of a catalogue (doc_id, text)."""
    words = docs.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("t")).withColumn("dl", F.size("t"))
    return words.select("doc_id", "dl", F.explode("t").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def corpus(docs: DataFrame) -> DataFrame:
    """One row: n_docs and avgdl."""
    return docs.select(F.size(tokens(F.coalesce("text", F.lit("")))).alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def idf(df: Column, n_docs: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25(docs: DataFrame, queries: DataFrame, top: int = 30) -> DataFrame:
    """(query_id, doc_id, score, rank) of the ``top`` documents for each query (query_id, text).

    Only postings of the queries' terms take part; they are dealt by document, so that a frequent
    term's postings lie in many tasks, and so are the sums.  Equal scores rank by doc_id.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("term"))
    asked = terms.select("term").distinct()
    own = postings(docs).join(asked, "term", "left_semi")
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    weight = df.join(F.broadcast(corpus(docs)), F.lit(True)).withColumn("idf", idf(F.col("df"), F.col("n_docs")))
    salted = own.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS).cast("long")))
    spread = terms.join(weight, "term").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    joined = salted.join(spread, ["term", "salt"]).select("query_id", "doc_id", "term", part.alias("part"))
    # parts are added in the order of their terms, so that equal documents get equal sums
    sums = joined.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("term", "part"))).alias("parts"))
    scored = sums.select("query_id", "doc_id", F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["part"]).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
