"""Judged hits, pools and the query x engine grid.

``judged_hit`` is one row per query, engine and rank.  The grid has every query and engine, also
those without hits, and is where rates over all queries start.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevara.functions.scalars import norm_id
from relevara.sources.sinks import kept

ENGINES = ("focal", "rival_a", "rival_b", "rival_c", "rival_d")
TIERS = ("simple", "medium", "complex")
#: 1e12 / log2(rank + 1), so that sums of gains are exact in whole numbers.
DISCOUNTS = [round(1e12 / math.log2(i + 2)) for i in range(20)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(names: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (index + 1).cast("int"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_mktsegment").alias("sector"), pick(TIERS, F.col("c_nationkey") % 3).alias("tier"))


def judged_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's judged hits, written once in a session and read by all queries over them."""
    return kept(spark, "judged-hit", sf_dir, lambda: built_hits(spark, sf_dir).repartition("query_id").sortWithinPartitions("query_id", "engine", "rank"))


def built_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture: an order's lines as an engine's results for the customer's query."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    e, p, q = F.col("e"), F.col("p"), F.col("query_id")
    # dealt by query once, which the groups, the ranks and the table's own order all go by
    each = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("query_id"), (F.col("l_suppkey") % 5).alias("e"), (F.col("l_partkey") % 60).alias("p"), "l_shipdate").repartition("query_id")
    found = each.groupBy("query_id", "e", "p").agg(F.min("l_shipdate").alias("d"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "e").orderBy("d", "p"))).filter("rank <= 20")
    h = (q * 7919 + p * 104729) % 100
    code = F.when(q % 12 == 0, 0).when(h < 40, F.when(q % 12 == 1, 10).otherwise(100)).when(h < 55, 10).when(h < 65, 1).otherwise(0)
    raw = F.when(e == 0, F.format_string("P-00-%02d", p)).otherwise(F.format_string("p00%02d", p))
    hits = ranked.join(queries(spark, sf_dir), "query_id").filter(~((e == 4) & (F.col("tier") == "complex") & (q % 10 < 6)))
    label = F.when(code == 100, "Exact").when(code == 10, "Substitute").when(code == 1, "Complementary").otherwise("Irrelevant")
    return hits.select("query_id", "sector", "tier", pick(ENGINES, e).alias("engine"), "rank", raw.alias("raw_id"), norm_id(raw).alias("norm_id"), code.alias("gain_code"), label.alias("label"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query with every engine."""
    return queries(spark, sf_dir).withColumn("engine", F.explode(F.array(*map(F.lit, ENGINES))))


def discount(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DISCOUNTS]), rank.cast("int"))


def pool(hits: DataFrame) -> DataFrame:
    """One row per query and product: its largest gain over all engines."""
    return hits.groupBy("query_id", "norm_id").agg(F.max("gain_code").alias("gain_code"))


def ideal(hits: DataFrame, ks: tuple[int, ...] = (10, 20)) -> DataFrame:
    """IDCG of each query from its pool, in fixed-point units, and the number of its Exact products: one pass over the pool."""
    order = Window.partitionBy("query_id").orderBy(F.desc("gain_code"), "norm_id")
    best = pool(hits).withColumn("r", F.row_number().over(order))
    at = lambda k: F.when(F.col("r") <= k, F.col("gain_code") * discount(F.least(F.col("r"), F.lit(len(DISCOUNTS))))).otherwise(0)
    return best.groupBy("query_id").agg(*[F.sum(at(k)).cast("long").alias(f"idcg{k}") for k in ks], F.count_if(F.col("gain_code") == 100).alias("n_exact"))


def exact_pool(hits: DataFrame) -> DataFrame:
    return hits.filter("gain_code = 100").groupBy("query_id").agg(F.countDistinct("norm_id").alias("n_exact"))
