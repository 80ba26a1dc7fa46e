"""Running sums along an order of all rows, without a window over all rows, and the cut of a stream of calls at its limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevara.sources.sinks import written

#: Rows of a range, and most ranges.
ROWS, MOST_RANGES = 1 << 18, 1 << 14


def running(spark: SparkSession, rows: DataFrame, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each of ``sums``, the sum of its expression over all rows before this one in the order.

    The rows are dealt to ranges of the order and written; a range's total is one row, and the totals of the ranges
    before it are added to sums within the range.  Expressions are whole numbers, so that sums are exact; null counts as 0.  Rows that agree in the
    whole order stand in any order among themselves unless ``order`` tells them apart.
    """
    for name in ("_range", *[f"_{s}" for s in sums]):
        if name in rows.columns:
            raise ValueError(f"column {name} is taken")
    valued = written(spark, rows.withColumns({f"_{s}": F.coalesce(x.cast("long"), F.lit(0).cast("long")) for s, x in sums.items()}))
    ranges = min(MOST_RANGES, max(1, -(-valued.count() // ROWS)))
    keys = [F.col(c).asc_nulls_first() for c in order]
    ranged = written(spark, valued.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_{s}").alias(s) for s in sums]).collect()  # one row per range
    before, at = [], dict.fromkeys(sums, 0)
    for t in sorted(totals, key=lambda r: r["_range"]):
        before.append((t["_range"], *[at[s] for s in sums]))
        at = {s: at[s] + t[s] for s in sums}
    offsets = spark.createDataFrame(before, ", ".join(["_of int", *[f"_before_{s} long" for s in sums]]))
    own = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({s: F.coalesce(F.sum(f"_{s}").over(own), F.lit(0)) for s in sums})
    both = local.join(F.broadcast(offsets), F.col("_range") == F.col("_of"))
    return both.select(*rows.columns, *[(F.col(s) + F.col(f"_before_{s}")).alias(s) for s in sums])


def budgeted(spark: SparkSession, calls: DataFrame, order: Sequence[str], budget: int, most_failures: int) -> DataFrame:
    """``calls`` (cost, failed, cached) with spent_before, failed_before and status.

    In order, a call that is cached costs nothing and is ``cached``; another one is ``aborted`` once the calls before it have cost
    more than ``budget`` or failed more than ``most_failures`` times, else ``failed`` or ``ok``.  What aborted calls would have cost
    doesn't matter, as sums never fall: beyond a limit every later call is aborted too.  A null cost is 0, a null flag false.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    sums = {"spent_before": F.when(~yes("cached"), F.col("cost")), "failed_before": (~yes("cached") & yes("failed")).cast("long")}
    rows = running(spark, calls, order, sums)
    over = (F.col("spent_before") > budget) | (F.col("failed_before") > most_failures)
    return rows.withColumn("status", F.when(yes("cached"), "cached").when(over, "aborted").when(yes("failed"), "failed").otherwise("ok"))
