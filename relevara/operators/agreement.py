"""Agreement between label sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevara.functions.scalars import GAIN_CODES, LABELS


def relabelled(hits: DataFrame, a: int, b: int, most: int) -> DataFrame:
    """A second label set: some judgments move on to the next class, cyclically."""
    p = F.substring("norm_id", -2, 2).cast("long")
    nxt = F.create_map(*[F.lit(x) for i, name in enumerate(LABELS) for x in (name, LABELS[(i + 1) % 4])])
    move = (F.col("query_id") * a + p * b) % 100 < most
    return hits.withColumn("label_b", F.when(move, nxt[F.col("label")]).otherwise(F.col("label")))


def gain_of(label):
    codes = F.create_map(*[F.lit(x) for kv in GAIN_CODES.items() for x in kv])
    return codes[label]


def confusion(pairs: DataFrame) -> DataFrame:
    """Four columns of counts for each first label; empty cells are 0."""
    return pairs.groupBy("label").pivot("label_b", list(LABELS)).count().na.fill(0)


def kappa(pairs: DataFrame, by: list[str]) -> DataFrame:
    """n, percent agreement and Cohen's kappa per slice; kappa is null where chance agrees wholly."""
    joint = pairs.groupBy(*by, "label", "label_b").count()
    n = joint.groupBy(*by).agg(F.sum("count").alias("n"), F.sum(F.when(F.col("label") == F.col("label_b"), F.col("count")).otherwise(0)).alias("same"))
    ends = joint.select(*by, F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("label").alias("l"), "count"), F.struct(F.lit("b").alias("side"), F.col("label_b").alias("l"), "count"))).alias("x")).select(*by, "x.*")
    both = ends.groupBy(*by, "l").agg(F.sum(F.when(F.col("side") == "a", F.col("count")).otherwise(0)).alias("na"), F.sum(F.when(F.col("side") == "b", F.col("count")).otherwise(0)).alias("nb"))
    chance = both.groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("cross"))
    joined = n.join(chance, by) if by else n.join(F.broadcast(chance), F.lit(True))  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("cross") / (F.col("n") * F.col("n"))
    return joined.select(*by, "n", F.round(po, 9).alias("agreement"), F.round(F.try_divide(po - pe, 1 - pe), 9).alias("kappa"))
