"""The metric cells a second time, by another way: lists of each query instead of windows, exact decimals instead of doubles.

Nothing here is shared with ``metrics`` but the discounts, so that equality of both at 1e-9 means something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevara.operators.judged import DISCOUNTS

#: A ratio of whole numbers with 18 decimals.
RATIO = "decimal(38,18)"


def ratio(a: Column, b: Column) -> Column:
    return (a.cast("decimal(20,0)") / b.cast("decimal(20,0)")).cast(RATIO)


def gained(gains: Column, k: int) -> Column:
    """Discounted sum of a list of gain codes, best first, up to place k."""
    steps = F.array(*[F.lit(d) for d in DISCOUNTS[:k]])
    parts = F.zip_with(F.slice(gains, 1, k), steps, lambda g, s: g.cast("long") * s)
    return F.aggregate(F.filter(parts, lambda x: x.isNotNull()), F.lit(0).cast("long"), lambda a, x: a + x)


def lists(hits: DataFrame, engines: tuple[str, ...], queries: DataFrame) -> DataFrame:
    """(query_id, sector, tier, engine, hits, pool): every query with every engine, the pool's gains best first, and its exact ids."""
    own = hits.groupBy("query_id").agg(F.collect_list(F.struct("engine", "rank", "norm_id", "gain_code")).alias("all"))
    each = queries.join(own, "query_id", "left").withColumn("all", F.coalesce("all", F.array().cast(own.schema["all"].dataType)))
    ids = F.array_distinct(F.transform("all", lambda h: h["norm_id"]))
    best = lambda i: F.array_max(F.transform(F.filter("all", lambda h: h["norm_id"] == i), lambda h: h["gain_code"]))
    pooled = F.reverse(F.array_sort(F.transform(ids, best)))
    exact = F.array_distinct(F.transform(F.filter("all", lambda h: h["gain_code"] == 100), lambda h: h["norm_id"]))
    wide = each.withColumns({"pool": pooled, "exact": exact}).withColumn("engine", F.explode(F.array(*map(F.lit, engines))))
    mine = F.array_sort(F.transform(F.filter("all", lambda h: h["engine"] == F.col("engine")), lambda h: F.struct(h["rank"].alias("rank"), h["norm_id"].alias("norm_id"), h["gain_code"].alias("gain_code"))))
    return wide.select("query_id", "sector", "tier", "engine", mine.alias("hits"), "pool", "exact")


def cells(hits: DataFrame, engines: tuple[str, ...], queries: DataFrame) -> DataFrame:
    """(slice, engine, metric, n, value): nDCG, recall, P@k and EZR overall, by sector and by tier; value is an exact mean with 18 decimals."""
    rows = lists(hits, engines, queries)
    gains = F.transform("hits", lambda h: h["gain_code"])
    metrics: dict[str, Column] = {"ezr": F.when(F.coalesce(F.array_max(gains), F.lit(0)) == 0, 1).otherwise(0).cast(RATIO)}
    for k in (10, 20):
        top = F.slice("hits", 1, k)
        ideal = gained(F.col("pool"), k)
        metrics[f"ndcg{k}"] = F.when(ideal > 0, ratio(gained(gains, k), F.greatest(ideal, F.lit(1))))
        found = F.size(F.array_intersect(F.transform(F.filter(top, lambda h: h["gain_code"] == 100), lambda h: h["norm_id"]), F.col("exact")))
        metrics[f"recall{k}"] = F.when(F.size("exact") > 0, ratio(found, F.greatest(F.size("exact"), F.lit(1))))
        total = F.aggregate(F.transform(top, lambda h: h["gain_code"].cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
        # P@k is stored with four decimals, halves up
        metrics[f"p{k}"] = F.round(F.when(F.size(top) > 0, ratio(total, F.greatest(F.size(top), F.lit(1)) * 100)).otherwise(F.lit(0).cast(RATIO)), 4).cast(RATIO)
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast(RATIO).alias("v")) for m, v in metrics.items()])
    long = rows.select("engine", "sector", "tier", F.explode(pairs).alias("p"))
    long = long.select("engine", F.explode(F.array(F.lit("overall"), "sector", "tier")).alias("slice"), "p.metric", "p.v").filter("v IS NOT NULL")
    sums = long.groupBy("slice", "engine", "metric").agg(F.sum(F.col("v").cast("decimal(38,18)")).alias("s"), F.count("*").alias("n"))
    return sums.select("slice", "engine", "metric", "n", (F.col("s") / F.col("n").cast("decimal(18,0)")).cast("double").alias("value"))
