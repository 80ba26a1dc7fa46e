"""A kept inverted index for BM25: documents are tokenised once, postings lie by term and block of documents.

A row of the index is a term in a block: its documents with lengths and counts, and the most that the term can add to
a score in this block.  A search first adds these bounds up for each query and block; the blocks with the largest bounds are
scored and give each query the k-th best score so far, and of the others only those are read whose bound reaches it.
A block's postings meet all queries of a group at once: a task holds the scores of a block's documents for a group of queries, in numpy,
and passes on the best of each query.  Documents and terms are added in the order of the terms, so equal documents have equal scores.

Defined cases: a null or empty text is a document without terms, which counts in the mean length and is never found; a query without
known terms finds nothing; repeated ids of documents are one document with the words of all.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevara.functions.scalars import tokens
from relevara.operators.retrieval import K1, B, idf
from relevara.sources.sinks import kept, written

#: Documents of a block, queries of a group, and blocks that are scored first.
DOCS, QUERIES, FIRST = 512, 256, 4
#: What rounding of bounds and scores may make.
SLACK = 1e-9


@dataclass(frozen=True)
class Index:
    """``postings`` (term, block, doc_ids, dls, tfs, most), ``terms`` (term, df, cf), and the corpus figures."""

    postings: DataFrame
    terms: DataFrame
    n_docs: int
    avgdl: float
    n_blocks: int


def build(spark: SparkSession, docs: DataFrame, key: str, block: int = DOCS) -> Index:
    """The index of a catalogue (doc_id, text), made once for each ``key`` of a session and kept in the shared folder."""
    corpus = kept(spark, "corpus", f"{key}/{block}", lambda: docs.agg(F.countDistinct("doc_id").alias("n_docs")))
    n_docs = corpus.first()["n_docs"]
    n_blocks = max(1, -(-n_docs // block))

    def counted() -> DataFrame:
        words = docs.select("doc_id", F.explode(tokens(F.coalesce("text", F.lit("")))).alias("term"))
        return words.groupBy("doc_id", "term").agg(F.count("*").cast("int").alias("tf"))

    counts = kept(spark, "counts", f"{key}/{block}", counted)
    terms = kept(spark, "terms", f"{key}/{block}", lambda: counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")))
    total = terms.agg(F.sum("cf")).first()[0] or 0
    avgdl = total / n_docs if n_docs else 0.0

    def blocks() -> DataFrame:
        lengths = counts.groupBy("doc_id").agg(F.sum("tf").cast("int").alias("dl"))
        rows = counts.join(lengths, "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int"))
        share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
        packed = rows.groupBy("term", "block").agg(F.array_sort(F.collect_list(F.struct("doc_id", "dl", "tf"))).alias("p"), F.max(share).alias("most"))
        return packed.select("term", "block", F.col("p.doc_id").alias("doc_ids"), F.col("p.dl").alias("dls"), F.col("p.tf").alias("tfs"), "most").sortWithinPartitions("term", "block")

    return Index(kept(spark, "postings", f"{key}/{block}", blocks), terms, n_docs, avgdl, n_blocks)


def best_of_block(rows: pa.Table, avgdl: float, k: int) -> pa.Table:
    """All rows of a part and block as (query_id, doc_id, score, matched): the k best of each query and what ties with them."""
    return pa.Table.from_batches([scored_block(rows.sort_by("term").to_pylist(), avgdl, k)])


def scored_block(rows: list[dict], avgdl: float, k: int) -> pa.RecordBatch:
    docs = np.unique(np.concatenate([r["doc_ids"] for r in rows]))
    queries = np.unique(np.concatenate([r["queries"] for r in rows]))
    score, matched = np.zeros((len(queries), len(docs))), np.zeros((len(queries), len(docs)), np.int32)
    for r in rows:
        tf, dl = np.array(r["tfs"], float), np.array(r["dls"], float)
        part = r["idf"] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
        at = np.ix_(np.searchsorted(queries, r["queries"]), np.searchsorted(docs, r["doc_ids"]))
        score[at] += part
        matched[at] += 1
    least = np.partition(score, -k, axis=1)[:, -k] if len(docs) > k else np.zeros(len(queries))
    q, d = np.nonzero((matched > 0) & (score >= least[:, None] - 2 * SLACK))
    columns = (pa.array(queries[q], pa.int64()), pa.array(docs[d], pa.int64()), pa.array(score[q, d]), pa.array(matched[q, d], pa.int32()))
    return pa.RecordBatch.from_arrays(list(columns), names=["query_id", "doc_id", "score", "matched"])


def search(spark: SparkSession, index: Index, queries: DataFrame, k: int = 30, first: int = FIRST) -> DataFrame:
    """(query_id, doc_id, score, rank, matched, n_terms): the ``k`` best documents of each query (query_id, text).

    ``matched`` is how many of the query's ``n_terms`` distinct terms the document has.  Equal scores, at nine decimals, rank by doc_id.
    """
    own = written(spark, queries.select(F.col("query_id").cast("long").alias("query_id"), F.array_distinct(tokens(F.coalesce("text", F.lit("")))).alias("t")), "queries")
    parts = max(1, -(-own.count() // QUERIES))
    terms = own.select("query_id", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), F.size("t").alias("n_terms"), F.explode("t").alias("term"))
    weighed = written(spark, terms.join(index.terms, "term").select("query_id", "part", "term", idf(F.col("df"), F.lit(index.n_docs)).alias("idf")), "asked")
    asked = weighed.groupBy("part", "term", "idf").agg(F.array_sort(F.collect_set("query_id")).alias("queries"))
    found, avgdl = "query_id long, doc_id long, score double, matched int", index.avgdl

    def run(wanted: DataFrame | None) -> DataFrame:
        met = index.postings.join(asked, "term")
        if wanted is not None:  # (part, block, only): of a group's queries those that read this block
            met = met.join(wanted, ["part", "block"]).withColumn("queries", F.array_intersect("queries", "only")).filter(F.size("queries") > 0)
        dealt = met.select("part", "block", "term", "idf", "queries", "doc_ids", "dls", "tfs")
        # grouped, which the plan must meet; a plain repartition falls to the join's own, and that one to local reads when the join turns out small
        best = dealt.groupBy("part", "block").applyInArrow(lambda rows: best_of_block(rows, avgdl, k), found)
        return written(spark, best, "scores")

    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    top = lambda rows: rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if index.n_blocks <= first:
        scores = run(None)
    else:
        bounds = index.postings.select("term", "block", "most").join(weighed, "term").groupBy("query_id", "part", "block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))
        near = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        ranked = written(spark, bounds.withColumn("nth", F.row_number().over(near)), "bounds")
        of = lambda rows: rows.groupBy("part", "block").agg(F.collect_set("query_id").alias("only"))
        scores = run(of(ranked.filter(F.col("nth") <= first)))
        floors = top(scores).filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        rest = ranked.filter(F.col("nth") > first).join(floors, "query_id", "left")
        rest = rest.filter(F.col("floor").isNull() | (F.col("bound") * (1 + SLACK) + SLACK >= F.col("floor")))
        scores = scores.unionByName(run(of(rest)))
    sizes = own.select("query_id", F.size("t").alias("n_terms"))
    return top(scores).join(sizes, "query_id").select("query_id", "doc_id", "score", "rank", "matched", "n_terms")


# functions go to the executors by value, which need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
