"""Exact top-k search by inner product over norm-sorted vectors.

Vectors become integers, floor(scale * x).  They are sorted by descending length and cut into
blocks.  The first block gives each query a first threshold, the k-th best score so far; by
Cauchy-Schwarz, only blocks whose longest vector times the query's length reaches it can matter,
and these are a prefix of the blocks; thresholds rise with what a task finds.  Within a block the vectors are rotated by the singular
vectors of all data, most of the product then lies in the leading coordinates, and a candidate
is dropped once its partial sum plus the product of both remaining lengths stays below the
threshold.  What is left is scored exactly in integers.

Queries travel in blocks too: a block of queries meets a block of vectors by an equi-join on
the block number.  How many ranges of vectors a block of queries has to meet is the number of ranges before it in one order of both,
so only pairs that may matter are ever made.  Two things travel to all tasks, both of fixed size: the rotation, and the first block.
The sum that the rotation comes from is added up in levels.

Defined cases: a vector that is null or has a null or non-finite component takes no part, nor
does a null id; shorter vectors count as filled up with zeros; an empty vector scores 0; a row
repeated whole is a candidate each time and asks once, and a query excludes the rows of its own id; rows of
one id with other vectors ask together, the best of all their scores count; ties go to the
smaller id; scores beyond 64 bits are cut to that range; an empty table gives an empty result; columns but vec_id and embedding are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevara.llm.common import ship, written
from relevara.operators.running import running

#: Vectors and queries of a block.
BLOCK, QUERIES = 1024, 1024
#: Leading coordinates of the first partial sum, and the share of pairs from which on single ones are summed.
LEAD, SPARSE = 4, 0.05
#: Matrices that one task adds up.
FAN, MOST_PARTS = 32, 1 << 15
#: Components and products below this are exact in doubles.
EXACT = float(2**52)


def decode(vectors: list[bytes], dim: int) -> np.ndarray:
    """Integer vectors as rows of doubles, filled up with zeros."""
    out = np.zeros((len(vectors), dim))
    for i, b in enumerate(vectors):
        v = np.frombuffer(b, np.float64)
        out[i, : len(v)] = v
    return out


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row inner products as 64-bit integers; Python's integers where doubles may not do."""
    most = np.abs(q).sum(1) * np.abs(x).max(1, initial=0.0)
    out = np.einsum("ij,ij->i", q, x) if len(q) else np.zeros(0)
    big = ~(most < EXACT)
    ints = np.where(big, 0, out).astype(np.int64)
    for i in np.flatnonzero(big):
        total = sum(int(a) * int(b) for a, b in zip(q[i], x[i], strict=True))
        ints[i] = max(-(2**63), min(2**63 - 1, total))
    return ints


def encoded_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, asks, norm, x) with x, an array of doubles, as the bytes of its numbers."""
    for b in batches:
        data = [np.array(v, np.float64).tobytes() for v in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(data, pa.binary())], names=["id", "asks", "norm", "data"])


def add_grams(g: pd.DataFrame) -> pd.DataFrame:
    """The sum of the matrices of up to FAN tasks, in the order of their numbers."""
    total = np.sum([np.frombuffer(b, np.float64) for b in g.sort_values("at")["gram"]], axis=0)
    return pd.DataFrame({"at": [int(g["at"].iloc[0]) // FAN], "gram": [total.tobytes()]})


def added_up(grams: DataFrame, tasks: int) -> DataFrame:
    """One matrix (at, gram) of those of all tasks, level by level."""
    while tasks > 1:
        grams = grams.groupBy(F.floor(F.col("at") / FAN)).applyInPandas(add_grams, "at long, gram binary")
        tasks = -(-tasks // FAN)
    return grams


def gram_batches(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((dim, dim))
    for b in batches:
        x = decode(b.column(0).to_pylist(), dim)
        scale = np.abs(x).max(initial=1.0)
        total += (x / scale).T @ (x / scale) if scale > 1e100 else x.T @ x
    at = TaskContext.get().partitionId() if TaskContext.get() else 0
    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total.tobytes()])], names=["at", "gram"])


def packed_batches(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """(block, first, data...) -> the same rows with the vectors of a row put into one array of bytes."""
    for b in batches:
        vectors = [decode(v, dim).tobytes() for v in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(vectors, pa.binary())], names=["block", "ids", "norms", "data"])


def best(q_ids: np.ndarray, v_ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k best, by score and then the smaller id."""
    order = np.lexsort((v_ids, ~scores, q_ids))
    q = q_ids[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < k]


def search_block(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, v_ids: np.ndarray, x: np.ndarray, rotation: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, vector, score) of the k best of a block for each query, where they reach its threshold, and how many pairs were scored."""
    qr, xr, dim = q @ rotation, x @ rotation, rotation.shape[0]
    lengths = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1))
    slack = 1e-9 * lengths + 1e-6
    alive = ~(lengths + slack < floor[:, None]) & (q_ids[:, None] != v_ids[None, :])
    # sums over all pairs, as products of matrices, while many are left; then over single pairs
    rows, cols, partial, at = None, None, np.zeros(alive.shape), 0
    for to in sorted({min(LEAD, dim), dim // 4, dim // 2, dim * 3 // 4, dim * 7 // 8, dim} - {0}):
        rest_q, rest_x = np.linalg.norm(qr[:, to:], axis=1), np.linalg.norm(xr[:, to:], axis=1)
        if rows is None:
            partial += qr[:, at:to] @ xr[:, at:to].T
            alive &= ~(partial + np.outer(rest_q, rest_x) + slack < floor[:, None])  # so stays what overflows
            if alive.mean() < SPARSE or to == dim:
                rows, cols = np.nonzero(alive)
                partial = partial[rows, cols]
        else:
            partial += np.einsum("ij,ij->i", qr[rows, at:to], xr[cols, at:to])
            keep = ~(partial + rest_q[rows] * rest_x[cols] + slack[rows, cols] < floor[rows])
            rows, cols, partial = rows[keep], cols[keep], partial[keep]
        at = to
    found: list[tuple] = []
    for i in range(0, len(rows), 1 << 16):
        r, c = rows[i : i + (1 << 16)], cols[i : i + (1 << 16)]
        s = exact_scores(q[r], x[c])
        reach = ~(s < floor[r])
        found.append((q_ids[r][reach], v_ids[c][reach], s[reach]))
    if not found:
        return (*(np.zeros(0, np.int64),) * 3, 0)
    qi, vi, s = (np.concatenate(y) for y in zip(*found, strict=True))
    use = best(qi, vi, s, k)
    return qi[use], vi[use], s[use], len(rows)


def search_batches(batches: Iterator[pa.RecordBatch], rotation: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Rows that hold a block of queries with thresholds and a block of vectors.

    A query's threshold rises with the scores that this task has found for it.
    """
    dim = rotation.shape[0]
    known: dict[int, np.ndarray] = {}
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("q_ids", "floors", "q_data", "ids", "data")]
        for q_ids, floors, q_data, ids, data in zip(*cols, strict=True):
            q, x = (np.frombuffer(d, np.float64).reshape(-1, dim) for d in (q_data, data))
            floor = np.array([-np.inf if f is None else f for f in floors])
            seen = [known.get(i) for i in q_ids]
            floor = np.maximum(floor, [-np.inf if s is None or len(s) < k else float(s[0]) for s in seen])
            *out, _ = search_block(np.array(q_ids), q, floor, np.array(ids), x, rotation, k)
            if len(set(q_ids)) == len(q_ids):  # one id, one vector
                ends = np.flatnonzero(np.concatenate([out[0][1:] != out[0][:-1], [True]])) + 1 if len(out[0]) else []
                for i, j in zip([0, *ends], ends, strict=False):
                    qid = int(out[0][i])
                    known[qid] = np.sort(np.concatenate([known.get(qid, out[2][:0]), out[2][i:j]]))[-k:]
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["query_id", "vec_id", "score"])


def first_batches(batches: Iterator[pa.RecordBatch], begin: tuple[list[int], bytes], rotation: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Blocks of queries (q_ids, q_data) against the first block of vectors: (query_id, vec_id, score)."""
    dim = rotation.shape[0]
    ids, x = np.array(begin[0]), np.frombuffer(begin[1], np.float64).reshape(-1, dim)
    for b in batches:
        for q_ids, q_data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            q = np.frombuffer(q_data, np.float64).reshape(-1, dim)
            *found, _ = search_block(np.array(q_ids), q, np.full(len(q_ids), -np.inf), ids, x, rotation, k)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in found], names=["query_id", "vec_id", "score"])


def blocks_of(rows: DataFrame, number: Column, dim: int) -> DataFrame:
    """Rows (id, norm, data) packed by ``number``, some hundreds each: (block, ids, norms, data)."""
    grouped = rows.withColumn("block", number).groupBy("block").agg(F.collect_list(F.struct("id", "norm", "data")).alias("r"))
    flat = grouped.select("block", "r.id", "r.norm", "r.data")
    return flat.mapInArrow(lambda it: packed_batches(it, dim), "block long, ids array<long>, norms array<double>, data binary")


def top_k(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def norm_sorted_search(spark: SparkSession, vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all other rows for each row where ``queries`` holds.

    ``vectors`` has vec_id and embedding.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    # floor() gives a long, which large components overflow: they are whole numbers anyway
    small = lambda y: F.when(F.abs(y) < EXACT, y)
    x = F.transform(F.col("embedding"), lambda c: F.coalesce(F.floor(small(c.cast("double") * scale)).cast("double"), c.cast("double") * scale))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * scale) < float("inf")))
    whole = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    rows = whole.select(F.col("vec_id").cast("long").alias("id"), queries.alias("asks"), x.alias("x"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)))
    rows = written(spark, rows)
    stats = rows.agg(F.max(F.size("x")).alias("dim"), F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    out = "query_id long, vec_id long, score long"
    if not stats["q"]:
        return spark.createDataFrame([], out).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    dim = max(stats["dim"], 1)
    rows = rows.select("id", "asks", "norm", "x").mapInArrow(encoded_batches, "id long, asks boolean, norm double, data binary")
    parts = min(MOST_PARTS, max(1, -(-stats["n"] // (BLOCK * 8))))
    gram = rows.select("data").coalesce(parts).mapInArrow(lambda it: gram_batches(it, dim), "at long, gram binary")
    total = np.sum([np.frombuffer(r["gram"], np.float64) for r in added_up(gram, parts).collect()], axis=0).reshape(dim, dim)
    rotation = np.linalg.eigh(total)[1][:, ::-1].copy() if np.isfinite(total).all() else np.eye(dim)
    shared = spark.sparkContext.broadcast(rotation)
    # blocks of vectors by descending length: ranges of the norm, each cut by a rank within its range
    n_ranges = max(1, -(-stats["n"] // (BLOCK * 8)))
    ranged = rows.repartitionByRange(n_ranges, F.desc("norm"), F.col("id")).withColumn("range", F.spark_partition_id())
    within = Window.partitionBy("range").orderBy(F.desc("norm"), "id")
    numbered = written(spark, ranged.withColumn("nth", F.floor((F.row_number().over(within) - 1) / BLOCK)).withColumn("block", F.col("range") * (1 << 20) + F.col("nth")))
    blocks = written(spark, blocks_of(numbered.select("id", "norm", "data", "block"), F.col("block"), dim))
    longest = numbered.groupBy("block").agg(F.max("norm").alias("longest"))
    asks = numbered.filter("asks").select("id", "norm", "data").distinct()
    per = Window.partitionBy("part").orderBy("id", "data")
    salted = asks.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-stats["q"] // (QUERIES * 8))))))
    in_blocks = salted.withColumn("q_block", F.col("part") * (1 << 20) + F.floor((F.row_number().over(per) - 1) / QUERIES))
    q_rows = written(spark, in_blocks.select("q_block", "id", "norm", "data"))
    # the first block of all gives the thresholds
    head = longest.orderBy("block").first()["block"]
    q_blocks = blocks_of(q_rows.withColumn("floor", F.lit(None).cast("double")), F.col("q_block"), dim)
    q_blocks = written(spark, q_blocks.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")))

    def run(pairs: DataFrame) -> DataFrame:
        both = pairs.join(blocks.select("block", "ids", "data"), "block").select("q_ids", "floors", "q_data", "ids", "data")
        return written(spark, both.mapInArrow(lambda it: search_batches(it, shared.value, k), out))

    # the first block travels to all blocks of queries
    start = blocks.filter(F.col("block") == head).select("ids", "data").first()
    begin = spark.sparkContext.broadcast((list(start["ids"]), bytes(start["data"])))
    first = written(spark, q_blocks.select("q_ids", "q_data").mapInArrow(lambda it: first_batches(it, begin.value, shared.value, k), out))
    floors = top_k(first, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") == k)
    known = q_rows.join(floors, q_rows["id"] == floors["query_id"], "left").select("q_block", "id", "norm", "data", F.col("floor").cast("double").alias("floor"))
    # a block can matter to a query if its longest vector may reach the threshold
    reach = known.withColumn("least", F.when(F.col("floor").isNull() | (F.col("norm") == 0), F.lit(-1.0)).otherwise(F.col("floor") / F.col("norm") * (1 - 1e-9) - 1e-6))
    least = reach.groupBy("q_block").agg(F.min("least").alias("least"), F.map_from_entries(F.collect_set(F.struct("id", F.coalesce("floor", F.lit(float("-inf")))))).alias("floor_of"))
    ends = longest.filter(F.col("block") != head).withColumn("range", F.shiftright("block", 20).cast("int"))
    # ranges lie by descending length: of those a block of queries meets the first ones, as many as reach it
    reach = longest.groupBy(F.shiftright("block", 20).cast("int").alias("range")).agg(F.max("longest").alias("least")).select("least", F.lit(0).alias("asks"), F.col("range").cast("long").alias("no"))
    both = reach.unionByName(least.select("least", F.lit(1).alias("asks"), F.col("q_block").alias("no"))).withColumn("down", -F.col("least"))
    met = running(spark, both, ["down", "asks", "no"], {"ranges": 1 - F.col("asks")}).filter("asks = 1 AND ranges > 0")
    every = least.join(met.select(F.col("no").alias("q_block"), F.explode(F.sequence(F.lit(0), (F.col("ranges") - 1).cast("int"))).alias("range")), "q_block")
    pairs = every.join(ends, "range").filter(F.col("longest") >= F.col("least"))
    with_q = pairs.join(q_blocks, "q_block").select("block", "q_ids", F.transform("q_ids", lambda i: F.element_at("floor_of", i)).alias("floors"), "q_data")
    rest = run(with_q)
    final = top_k(first.unionByName(rest), k)
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ship(__name__)
