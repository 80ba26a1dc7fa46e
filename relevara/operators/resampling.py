"""Bootstrap of whole queries for many metrics at once: the metrics of a population share the draws of a replicate.

A stream is a slice and a population of queries; its rows have one difference for each test.  A
replicate draws as many queries as the stream has.  How many of them fall into each part of the stream is a
multinomial draw over the parts' sizes, which every task makes alike from the seed; within its part a task draws
queries, counts how often each is drawn, and multiplies the counts with the part's differences.  So a task holds a
part and a block of replicates, whatever the size of the stream, and all that travels is a row of sums for each part and replicate.

Differences are whole numbers, 1 / UNIT each, so that sums don't depend on their order and a mean of exactly zero counts as one.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevara.sources.sinks import written

UNIT = 1_000_000_000
#: Queries of a part, and replicates of a block.
PART, BLOCK = 1 << 15, 250


def stream_seed(seed: int, stream: str) -> list[int]:
    return [seed, zlib.crc32(stream.encode())]


def block_counts(seed: int, stream: str, block: int, size: int, sizes: np.ndarray, part: int) -> Iterator[np.ndarray]:
    """For each replicate of a block how often each query of the part is drawn."""
    own = stream_seed(seed, stream)
    shares = np.random.default_rng([*own, 0, block]).multinomial(int(sizes.sum()), sizes / sizes.sum(), size)
    rng = np.random.default_rng([*own, 1, block, part])
    for n in shares[:, part]:
        yield np.bincount(rng.integers(0, sizes[part], n), minlength=sizes[part])


def part_totals(frames: Iterator[pd.DataFrame], seed: int, replicates: int) -> Iterator[pd.DataFrame]:
    """(stream, rep, totals) of each part, block of replicates by block."""
    for frame in frames:
        for r in frame.to_dict("records"):
            d = np.array([list(x) for x in r["diffs"]], float)
            sizes = np.array(r["sizes"], np.int64)
            for first in range(0, replicates, BLOCK):
                size = min(BLOCK, replicates - first)
                counts = np.stack(list(block_counts(seed, r["stream"], first // BLOCK, size, sizes, r["part"])))
                totals = np.rint(counts @ d).astype(np.int64)  # exact in doubles: a part's sums stay below 2**53
                yield pd.DataFrame({"stream": r["stream"], "rep": first + np.arange(size), "totals": list(totals)})


def resampled(spark: SparkSession, rows: DataFrame, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """(stream, rep, n, totals): sums of each difference over the queries that a replicate draws.

    ``rows`` has stream (a string), query_id and diffs, an array of whole numbers of the same length within a stream.  A stream's
    draws depend on its name, the seed and its queries alone.
    """
    # parts by the rank of the hash would need a sort; the hash itself deals queries evenly
    n = rows.groupBy("stream").agg(F.count("*").alias("n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / PART)).cast("int")
    dealt = rows.join(F.broadcast(n), "stream").withColumn("part", F.pmod(F.xxhash64("query_id"), parts).cast("int"))
    lists = dealt.groupBy("stream", "part").agg(F.array_sort(F.collect_list(F.struct("query_id", "diffs"))).alias("x"))
    kept = written(spark, lists.select("stream", "part", F.col("x.diffs").alias("diffs"), F.size("x").cast("long").alias("m")), "parts")
    # one list of part sizes for each stream; empty parts have none and get a zero
    sized = kept.groupBy("stream").agg(F.map_from_entries(F.collect_list(F.struct("part", "m"))).alias("by"), F.max("part").alias("last"), F.sum("m").alias("n"))
    sizes = sized.select("stream", "n", F.transform(F.sequence(F.lit(0), "last"), lambda i: F.coalesce(F.try_element_at("by", i), F.lit(0).cast("long"))).alias("sizes"))
    # a part travels once and its task makes all replicates of it
    work = kept.join(F.broadcast(sizes), "stream").repartition("stream", "part")
    sums = work.mapInPandas(lambda it: part_totals(it, seed, replicates), "stream string, rep int, totals array<long>")
    each = sums.select("stream", "rep", F.posexplode("totals").alias("test", "total"))
    total = each.groupBy("stream", "rep", "test").agg(F.sum("total").alias("total"))
    return total.join(F.broadcast(sizes.select("stream", "n")), "stream")


def tested(boot: DataFrame) -> DataFrame:
    """(stream, test, n, ci_low, ci_high, p_raw, n_replicates): percentile interval and two-sided p of each test's mean."""
    mean = F.col("total") / F.col("n") / UNIT
    low, high = F.avg((F.col("total") <= 0).cast("int")), F.avg((F.col("total") >= 0).cast("int"))
    out = boot.groupBy("stream", "test", "n").agg(F.percentile(mean, F.array(F.lit(0.025), F.lit(0.975))).alias("ci"), F.least(F.lit(1.0), 2 * F.least(low, high)).alias("p_raw"), F.count("*").alias("n_replicates"))
    return out.select("stream", "test", "n", F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"), "p_raw", "n_replicates")


# functions go to the executors by value, which need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
