"""Connected components by alternating large-star and small-star steps; nothing goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevara.llm.common import checked, forget, ship, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); label is the smallest node of its component."""
    at = written(spark, edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(at)
    while state[0]:
        both = at.union(at.select("v", "u"))
        least = written(spark, both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = written(spark, both.join(checked(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        forget(spark, least)
        least = written(spark, large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(checked(least), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(spark, small.union(least.select("u", "m")).distinct())
        forget(spark, least, large, at)
        at, before, state = new, state, _state(new)
        if state == before:
            break
    ends = at.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return written(spark, ends.union(ends.select("label", "label")).distinct())


ship(__name__)
