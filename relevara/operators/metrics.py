"""Ranking metrics.  Undefined is not zero: nDCG and recall leave queries out, the other rates take all.

All sums are whole numbers with one division at the end, so results do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevara.operators.judged import discount, grid, ideal, judged_hit


def query_engine(spark: SparkSession, sf_dir: str, hits: DataFrame | None = None) -> DataFrame:
    """One row per query and engine with all per-query counts and sums: a single pass over the hits."""
    hits = judged_hit(spark, sf_dir) if hits is None else hits
    # the first place of each product in a list carries it in the counts of distinct products
    hits = hits.withColumn("first", F.row_number().over(Window.partitionBy("query_id", "engine", "norm_id").orderBy("rank")) == 1)
    at = lambda k, x: F.sum(F.when(F.col("rank") <= k, x).otherwise(0)).cast("long")
    one = F.lit(1)
    own = hits.groupBy("query_id", "engine").agg(
        F.count("*").alias("n_hits"),
        F.max("gain_code").alias("best"),
        F.count_if(F.col("gain_code") == 100).alias("nrel"),
        *[at(k, F.col("gain_code") * discount(F.col("rank"))).alias(f"dcg{k}") for k in (10, 20)],
        *[at(k, one).alias(f"n{k}") for k in (10, 20)],
        *[at(k, F.col("gain_code")).alias(f"gain{k}") for k in (10, 20)],
        *[at(k, (F.col("gain_code") == 0).cast("int")).alias(f"junk{k}") for k in (10, 20)],
        *[F.count_if((F.col("rank") <= k) & (F.col("gain_code") == 100) & F.col("first")).alias(f"exact{k}") for k in (10, 20)],
    )
    full = grid(spark, sf_dir).join(own, ["query_id", "engine"], "left").na.fill(0)
    return full.join(ideal(hits), "query_id", "left").na.fill(0, ["idcg10", "idcg20", "n_exact"])


def mean(x: Column) -> Column:
    return F.round(F.avg(x), 9)


def ndcg(k: int) -> Column:
    return F.when(F.col(f"idcg{k}") > 0, F.col(f"dcg{k}") / F.col(f"idcg{k}"))


def precision(k: int) -> Column:
    """Mean gain of the returned top k, stored with four decimals."""
    return F.when(F.col(f"n{k}") > 0, F.expr(f"(200 * gain{k} + n{k}) div (2 * n{k})") / 10000).otherwise(0.0)


def recall(k: int) -> Column:
    return F.when(F.col("n_exact") > 0, F.col(f"exact{k}") / F.col("n_exact"))


def junk(k: int) -> Column:
    return F.when(F.col(f"n{k}") > 0, F.col(f"junk{k}") / F.col(f"n{k}"))


def zero() -> Column:
    return (F.col("n_hits") == 0).cast("int")


def all_junk() -> Column:
    return ((F.col("n_hits") > 0) & (F.col("best") == 0)).cast("int")


def ezr() -> Column:
    return (F.col("best") == 0).cast("int")


def cells(rows: DataFrame, *metrics: Column) -> DataFrame:
    """Macro averages overall, per sector and per tier in one pass."""
    out = rows.groupingSets([["engine"], ["engine", "sector"], ["engine", "tier"]], "engine", "sector", "tier").agg(F.count("*").alias("n"), *metrics)
    return out.withColumn("slice", F.coalesce("sector", "tier", F.lit("overall"))).drop("sector", "tier")


def self_ideal(hits: DataFrame, k: int) -> DataFrame:
    """Per query and engine: DCG over that of the same hits in ideal order, 0 where nothing is relevant."""
    own = Window.partitionBy("query_id", "engine")
    ranked = hits.filter(F.col("rank") <= k).withColumn("i", F.row_number().over(own.orderBy(F.desc("gain_code"), "norm_id")))
    sums = ranked.groupBy("query_id", "engine").agg(F.sum(F.col("gain_code") * discount(F.col("rank"))).alias("dcg"), F.sum(F.col("gain_code") * discount(F.col("i"))).alias("best"))
    return sums.select("query_id", "engine", F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0).alias("score"))
