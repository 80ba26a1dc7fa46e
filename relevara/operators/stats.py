"""Paired bootstrap, Holm's step-down, families of tests, average-tie ranks and Spearman's correlation."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: multipliers of the mixing of 32 bits and the step between draws
MIX = ((16, 0x7FEB352D), (15, 0x31848BAB), (14, 0x2C1B3C6D))
STEP = 0x1E3779B1
#: Replicates that a row of work has, and draws of one numpy step.
BLOCK, DRAWS = 100, 1 << 18
#: Distinct differences that a cell may have here; metrics of more belong to ``resampling``, which never holds a whole cell.
MOST_VALUES = 100_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Mixes 32 bits; arithmetic wraps."""
    x = x.astype(np.uint32)
    for shift, factor in MIX:
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    return x ^ x >> np.uint32(16)


def paired(scores: DataFrame, focal: str) -> DataFrame:
    """focal - rival of each query and rival; ``scores`` has query_id, engine, score, slice columns.

    A query that only one side has is an error: every rival must be paired with every query.
    """
    a = scores.filter(F.col("engine") == focal).select("query_id", F.col("score").alias("focal_score"), F.lit(True).alias("has_focal"))
    b = scores.filter(F.col("engine") != focal).withColumn("has_rival", F.lit(True))
    both = b.join(a, "query_id", "full")
    whole = F.when(F.col("has_focal") & F.col("has_rival"), F.col("focal_score") - F.col("score")).otherwise(F.raise_error(F.concat(F.lit("unpaired query "), F.col("query_id").cast("string"))))
    return both.withColumn("diff", whole).drop("has_focal", "has_rival")


def replicate_totals(frames: Iterator[pd.DataFrame], cell: list[str]) -> Iterator[pd.DataFrame]:
    """Totals of each replicate of a row's block, from the cell's distinct differences and their counts."""
    for frame in frames:
        out = []
        for r in frame.to_dict("records"):
            values, ends = np.array([v["diff"] for v in r["values"]], float), np.cumsum([v["times"] for v in r["values"]])
            keys = mixed(mixed(np.array([(r["seed"] * 65536 + r["cell_no"]) % 2**32])) + np.arange(r["first"], r["first"] + r["size"], dtype=np.uint32))
            n, totals = int(ends[-1]), np.zeros(r["size"])
            for at in range(0, n, DRAWS):
                draws = np.arange(at, min(at + DRAWS, n), dtype=np.uint32) * np.uint32(STEP)
                many = max(1, DRAWS // len(draws))
                for i in range(0, len(keys), many):
                    index = mixed(draws[None, :] + keys[i : i + many, None]) % np.uint32(n)
                    if len(ends) <= 8:
                        below = np.stack([(index < e).sum(1) for e in ends], 1)
                        totals[i : i + many] += np.diff(below, prepend=0) @ values
                    else:
                        totals[i : i + many] += values[np.searchsorted(ends, index, "right")].sum(1)
            out.append(pd.DataFrame({**{c: [r[c]] * r["size"] for c in cell}, "rep": np.arange(r["first"], r["first"] + r["size"]), "total": totals, "n": n}))
        if out:
            yield pd.concat(out)


def bootstrap(diffs: DataFrame, cell: list[str], replicates: int = 10_000, seed: int = 42, digits: int = 9) -> DataFrame:
    """(cell, rep, total, n): sums of ``diff`` over resamples of whole queries, as many as the cell has.

    The queries of a cell stand in order of their differences, rounded to ``digits``, so that a
    cell is its distinct differences and their counts.  Draw i of replicate r takes the query
    number mixed(mixed(mixed(seed, cell) + r) + i * STEP) mod n: each cell has a stream of its own.
    A cell of more than MOST_VALUES distinct differences is an error: it would be one row.
    """
    counts = diffs.groupBy(*cell, F.round("diff", digits).alias("diff")).agg(F.count("*").alias("times"))
    too_many = counts.groupBy(*cell).count().filter(F.col("count") > MOST_VALUES).limit(1).collect()
    if too_many:
        raise ValueError(f"{too_many[0].asDict()}: more distinct differences than {MOST_VALUES}; use relevara.operators.resampling")
    per = counts.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("diff", "times"))).alias("values"))
    numbered = per.withColumn("cell_no", F.row_number().over(Window.orderBy(*cell)))  # one row per cell
    first = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(BLOCK)))
    work = numbered.withColumn("first", first).withColumn("size", F.least(F.lit(BLOCK), F.lit(replicates) - F.col("first"))).withColumn("seed", F.lit(seed))
    kinds = dict(diffs.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in cell] + ["rep int", "total double", "n long"])
    return work.repartition(64, *cell, "first").mapInPandas(lambda it: replicate_totals(it, cell), schema)


def interval(boot: DataFrame, cell: list[str]) -> DataFrame:
    """Percentile interval and two-sided empirical p of each cell."""
    m = F.col("total") / F.col("n")
    low, high = F.avg((m <= 0).cast("int")), F.avg((m >= 0).cast("int"))
    out = boot.groupBy(*cell).agg(F.percentile(m, F.array(F.lit(0.025), F.lit(0.975))).alias("ci"), F.least(F.lit(1.0), 2 * F.least(low, high)).alias("p_raw"), F.count("*").alias("n_replicates"))
    return out.select(*cell, F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"), "p_raw", "n_replicates")


def holm(tests: DataFrame, family: list[str], tie: list[str], alpha: float = 0.05) -> DataFrame:
    """Adds p_holm and significant within each family of tests."""
    order = Window.partitionBy(*family).orderBy("p_raw", *tie)
    m, rn = F.count("*").over(Window.partitionBy(*family)), F.row_number().over(order)
    step = tests.withColumn("_step", (m - rn + 1) * F.col("p_raw"))
    p = F.least(F.lit(1.0), F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return step.withColumn("p_holm", p).withColumn("significant", F.col("p_holm") < alpha).drop("_step")


def average_ranks(x: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    own, tied = Window.partitionBy(*group).orderBy(value), Window.partitionBy(*group, value)
    return x.withColumn(name, F.rank().over(own) + (F.count("*").over(tied) - 1) / 2)


def families(**sources: DataFrame) -> DataFrame:
    """The union of families of tests, each row tagged with its source."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def flips(tests: DataFrame, before: str, after: str) -> DataFrame:
    """Tests that are significant in one family and not in the other."""
    return tests.filter(F.col(before) != F.col(after)).withColumn("direction", F.when(F.col(after), "gained").otherwise("lost"))


def stable(rho: Column, largest_delta_pp: Column) -> Column:
    """Whether orders correlate at 0.9 or more and no cell moves by 5 points or more."""
    return (rho >= 0.9) & (F.abs(largest_delta_pp) < 5.0)


def forest(tests: DataFrame, lower_is_better: Mapping[str, bool]) -> DataFrame:
    """Advantage of the focal engine in points with its interval; turned round where lower is better."""
    turn = F.lit(False)
    for metric, low in lower_is_better.items():
        turn = F.when(F.col("metric") == metric, F.lit(low)).otherwise(turn)
    pick = lambda a, b: F.when(turn, (0 - F.col(b)) * 100).otherwise(F.col(a) * 100)
    return tests.withColumns({"adv": pick("diff", "diff"), "lo": pick("ci_low", "ci_high"), "hi": pick("ci_high", "ci_low")}).withColumn("clear_of_zero", F.col("lo") > 0)


# functions go to the executors by value, which need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
