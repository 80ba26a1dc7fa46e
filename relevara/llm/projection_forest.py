"""Approximate nearest neighbours by cosine: a forest of random-projection trees with one queue for all trees.

A tree halves the space at each of its levels: by a random direction, orthogonal to those of the
levels above, at the median of a bounded sample.  Every row lies in one leaf of each tree.  What a query
still has to cross to get into a leaf, the sum of the squared distances to the planes that part
them, is the leaf's place in the queue; it never falls along a path, so the leaves that a heap
over all trees would pop first are those of the smallest sums, and a batch of queries takes its
leaves by a partial sort over all trees.  How many leaves it takes is fitted once: so many as find
the wanted share of the true neighbours within the sample.  Candidates are scored exactly.

Leaves are cut into blocks, queries of a leaf too, and blocks meet by an equi-join on the leaf's
number; only the forest, whose size the sample bounds, travels to all.  Of equal vectors only the ``k + 1`` smallest ids
can be among the nearest, so a vector that most rows share is a few rows.

Defined cases: a vector that is null, zero, or has a null or non-finite component takes no part,
nor does a null id; shorter vectors count as filled up with zeros; a row repeated whole counts
once, and a query excludes the rows of its own id; rows of one id with other vectors ask together, the
best of their scores counts; ties go to the smaller id; an empty table, or one without queries,
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevara.llm.common import forget, ship, written

#: Trees, rows of a leaf at best, and the share of the sample's true neighbours that the leaves taken must hold.
TREES, LEAF, TARGET = 4, 1024, 0.96
#: Rows and bytes of the sample, its rows that stand for queries, and its rows in a leaf at least.
SAMPLE, SAMPLE_BYTES, TRIALS, LEAST = 16_384, 64 << 20, 256, 24
#: Vectors and queries of a block.
BLOCK, QUERIES = 2048, 512
#: Differences of cosines that rounding of products may make.
SLACK = 1e-9
#: Numbers of blocks of a leaf.
SHIFT = 1 << 20


def decoded(data: list[bytes], kind: str, dim: int) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros and scaled by a power of two, so that no square is lost."""
    out = np.zeros((len(data), dim))
    for i, b in enumerate(data):
        v = np.frombuffer(b, kind)
        out[i, : len(v)] = v
    _, power = np.frexp(np.abs(out).max(1, initial=0.0))
    return np.ldexp(out, -power[:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Forest:
    """Directions (trees, levels, dim) and thresholds of each tree's levels, one for each node."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, k: int, target: float, seed: int = 11) -> None:
        rng, dim = np.random.default_rng(seed), sample.shape[1]
        self.depth, self.leaves = depth, 1 << depth
        self.trees = trees if depth else 1
        w = rng.normal(size=(self.trees, depth, dim))
        for t in range(self.trees):
            if 0 < depth <= dim:
                w[t] = np.linalg.qr(w[t].T)[0].T
            elif depth:
                w[t] = unit(w[t])
        self.directions = w.reshape(-1, dim)
        self.cuts: list[list[np.ndarray]] = []
        p = self.projected(sample)
        for t in range(self.trees):
            node, cuts = np.zeros(len(sample), np.int64), []
            for level in range(depth):
                x, cut = p[:, t, level], np.zeros(1 << level)
                order = np.lexsort((x, node))
                ends = np.searchsorted(node[order], np.arange((1 << level) + 1))
                for j, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    if b > a:
                        cut[j] = (x[order[(a + b - 1) // 2]] + x[order[(a + b) // 2]]) / 2
                cuts.append(cut)
                node = node * 2 + (x > cut[node])
            self.cuts.append(cuts)
        leaf = self.leaf(sample)
        #: Share of the rows in each leaf, and leaves that a query takes.
        self.share = np.bincount(leaf.ravel(), minlength=self.trees * self.leaves) / max(1, len(sample))
        self.visits = self.fitted(sample, leaf, k, target)

    def projected(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.directions.T).reshape(len(x), self.trees, self.depth)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, numbered over all trees."""
        p, out = self.projected(x), np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            for level in range(self.depth):
                out[:, t] = out[:, t] * 2 + (p[:, t, level] > self.cuts[t][level][out[:, t]])
        return out + np.arange(self.trees) * self.leaves

    def crossed(self, q: np.ndarray) -> np.ndarray:
        """For each query and leaf of all trees the squared distances to the planes between them, summed."""
        p, parts = self.projected(q), []
        for t in range(self.trees):
            cost = np.zeros((len(q), 1))
            for level in range(self.depth):
                m = p[:, t, level, None] - self.cuts[t][level][None, :]
                cost = np.stack([cost + np.maximum(m, 0) ** 2, cost + np.maximum(-m, 0) ** 2], 2).reshape(len(q), -1)
            parts.append(cost)
        return np.concatenate(parts, 1)

    def first(self, q: np.ndarray) -> np.ndarray:
        """The leaves that the queue gives each query first."""
        cost = self.crossed(q)
        n = min(self.visits, cost.shape[1])
        return np.argpartition(cost, n - 1, axis=1)[:, :n] if n < cost.shape[1] else np.broadcast_to(np.arange(n), cost.shape)

    def fitted(self, sample: np.ndarray, leaf: np.ndarray, k: int, target: float) -> int:
        """Leaves from the queue that hold ``target`` of the true ``k`` neighbours within the sample."""
        q = sample[:TRIALS]
        if not self.depth or len(sample) <= k:
            return 1
        sims = q @ sample.T
        sims[np.arange(len(q)), np.arange(len(q))] = -np.inf
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(self.crossed(q), axis=1, kind="stable"), axis=1)
        found = place[np.arange(len(q))[:, None, None], leaf[near]].min(2)  # of the neighbour's leaves the first
        return max(2, int(np.quantile(found, target, method="higher")) + 1)


def leaf_batches(batches: Iterator[pa.RecordBatch], forest: Forest, kind: str, dim: int, blocks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, data) as a row for each tree: (block, id, data); a leaf's rows are dealt to its blocks by id."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            ids, data = part.column(0), part.column(1)
            leaf = forest.leaf(unit(decoded(data.to_pylist(), kind, dim)))
            dealt = (ids.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for t in range(forest.trees):
                block = leaf[:, t] * SHIFT + (dealt % blocks[leaf[:, t]].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(block), ids, data], names=["block", "id", "data"])


def query_batches(batches: Iterator[pa.RecordBatch], forest: Forest, kind: str, dim: int, groups: int) -> Iterator[pa.RecordBatch]:
    """(id, data) as a row for each leaf that the query visits: (block, id, data), block being the leaf and a group of queries."""
    for b in batches:
        for at in range(0, b.num_rows, QUERIES):
            part = b.slice(at, QUERIES)
            ids = part.column(0).to_numpy()
            leaves = forest.first(unit(decoded(part.column(1).to_pylist(), kind, dim)))
            rows = np.repeat(np.arange(part.num_rows), leaves.shape[1])
            group = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(groups)
            block = leaves.ravel() * SHIFT + group.astype(np.int64)[rows]
            for i in range(0, len(rows), 1 << 14):
                take = pa.array(rows[i : i + (1 << 14)])
                yield pa.RecordBatch.from_arrays([pa.array(block[i : i + (1 << 14)]), part.column(0).take(take), part.column(1).take(take)], names=["block", "id", "data"])


def nearest(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, cosine) of each query's k nearest in a block; cosines depend on the two vectors alone."""
    qq, xx = (np.sqrt(np.einsum("ij,ij->i", y, y)) for y in (q, x))
    sims = (q / qq[:, None]) @ (x / xx[:, None]).T
    sims[q_ids[:, None] == v_ids[None, :]] = -np.inf
    at = min(k, sims.shape[1])
    least = np.partition(sims, -at, axis=1)[:, -at]
    rows, cols = np.nonzero((sims >= least[:, None] - SLACK) & (sims > -np.inf))
    score = np.empty(len(rows))
    for i in range(0, len(rows), 1 << 14):
        r, c = rows[i : i + (1 << 14)], cols[i : i + (1 << 14)]
        score[i : i + (1 << 14)] = np.einsum("ij,ij->i", q[r], x[c]) / (qq[r] * xx[c])
    order = np.lexsort((v_ids[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    start = np.searchsorted(rows, np.arange(len(q_ids)))
    keep = np.arange(len(rows)) - start[rows] < k
    return q_ids[rows[keep]], v_ids[cols[keep]], score[keep]


def search_batches(batches: Iterator[pa.RecordBatch], kind: str, dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows that hold queries and vectors of one leaf: (query_id, vec_id, score)."""
    for b in batches:
        for qs, vs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            q, x = (decoded([r["data"] for r in side], kind, dim) for side in (qs, vs))
            out = nearest(np.array([r["id"] for r in qs]), q, np.array([r["id"] for r in vs]), x, k)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])


def encoded_batches(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """(id, asks, x) with the numbers of x as bytes."""
    for b in batches:
        data = [np.array(v, kind).tobytes() for v in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], names=["id", "asks", "data"])


def drawn_rows(distinct: DataFrame, n: int, want: int) -> DataFrame:
    """The ``want`` rows of ``n`` different (id, data) with the smallest hashes, in their order.

    A bound on the hash leaves few more rows than wanted before they are ordered, so that all tasks together, not each
    of them, send that many to the driver.
    """
    hashed, share = distinct.withColumn("h", F.xxhash64("id", "data")), (want + 8 * math.sqrt(want) + 64) / max(1, n)
    few = hashed
    while share < 1:
        few = hashed.filter(F.col("h") < int(share * 2**64) - 2**63)
        if few.count() >= want:
            break
        few, share = hashed, 2 * share
    return few.orderBy("h", "id", "data").limit(want).select("id", "data")


def forest_search(spark: SparkSession, vectors: DataFrame, queries: Column, k: int = 5, trees: int = TREES, target: float = TARGET, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found among all other rows for each row where ``queries`` holds.

    ``vectors`` has vec_id and embedding.  The forest is fitted on the SAMPLE rows (fewer where SAMPLE_BYTES bounds
    them) with the smallest hashes; every row is indexed.
    """
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    limit = float("inf")
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < limit)) & F.exists("embedding", lambda c: c != 0)
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), "embedding")
    rows = written(spark, rows.mapInArrow(lambda it: encoded_batches(it, kind), "id long, asks boolean, data binary"))
    stats = rows.agg(F.max(F.length("data")).alias("bytes"), F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    out = "query_id long, vec_id long, score double"
    if not stats["q"]:
        return spark.createDataFrame([], out).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    dim = stats["bytes"] // np.dtype(kind).itemsize
    same = Window.partitionBy("data").orderBy("id")
    once = rows.select("id", "data").distinct()
    distinct = written(spark, once.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1).select("id", "data"))
    n = distinct.count()
    sample = drawn_rows(distinct, n, max(2, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))).toPandas()
    drawn = unit(decoded(list(sample["data"]), kind, dim))
    depth = 0
    while n >> depth > leaf and len(drawn) >> (depth + 1) >= LEAST:
        depth += 1
    forest = Forest(drawn, depth, trees, k, target)
    shared = spark.sparkContext.broadcast(forest)
    # blocks by the rows that a leaf has if all are as the sample
    blocks = np.maximum(1, np.ceil(forest.share * n / BLOCK)).astype(np.int64)
    groups = max(1, -(-stats["q"] * forest.visits // (forest.trees * forest.leaves * QUERIES)))
    both = "block long, id long, data binary"
    own = distinct.mapInArrow(lambda it: leaf_batches(it, shared.value, kind, dim, blocks), both)
    asks = rows.filter("asks").select("id", "data").distinct().mapInArrow(lambda it: query_batches(it, shared.value, kind, dim, groups), both)
    # dealt by leaf once, for blocks and join alike; a merge, as Spark takes the queries' rows for no more than the queries and would send them all to the driver
    packed = lambda df, name: df.withColumn("leaf", F.shiftright("block", 20)).repartition("leaf").groupBy("leaf", "block").agg(F.collect_list(F.struct("id", "data")).alias(name)).drop("block")
    pairs = packed(asks, "q").join(packed(own, "v").hint("merge"), "leaf").select("q", "v")
    found = written(spark, pairs.mapInArrow(lambda it: search_batches(it, kind, dim, k), out))
    forget(spark, distinct)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ship(__name__)
