"""Validation gates: computed figures against expected ones.  A gate gives its rows; ``enforce`` stops on any that fails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compared(got: DataFrame, want: DataFrame, keys: list[str], tolerance: float = 0.0, truncated: bool = False) -> DataFrame:
    """(keys, got, want, passes): a key that only one side has fails.

    Values pass within ``tolerance``, or, with ``truncated``, if cutting to two decimals gives the wanted value.
    """
    both = got.withColumnRenamed("value", "got").join(want.withColumnRenamed("value", "want"), keys, "full")
    passes = F.abs(F.col("got") - F.col("want")) <= tolerance
    if truncated:
        passes = passes | (F.abs(F.floor(F.col("got") * 100) / 100 - F.col("want")) < 1e-9)
    return both.select(*keys, "got", "want", F.coalesce(passes, F.lit(False)).alias("passes"))


def enforce(gate: DataFrame, name: str) -> None:
    """Raises with the first failures."""
    bad = gate.filter(~F.col("passes")).limit(10).collect()
    if bad:
        raise ValueError(f"{name}: " + "; ".join(str(r.asDict()) for r in bad))


def provenance(tests: DataFrame, rows: dict[str, int], seed: int, replicates: int) -> DataFrame:
    """(source, n, passes): each source has its number of tests, all of one seed and number of replicates."""
    want = F.create_map(*[F.lit(x) for kv in rows.items() for x in kv])
    per = tests.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("seed") != seed).alias("other_seed"), F.count_if(F.col("n_replicates") != replicates).alias("other_replicates"))
    fine = (F.col("n") == F.try_element_at(want, F.col("source"))) & (F.col("other_seed") == 0) & (F.col("other_replicates") == 0)
    return per.withColumn("passes", F.coalesce(fine, F.lit(False)))


def content_hash(df: DataFrame) -> DataFrame:
    """(n, low, high): a hash of all rows that does not depend on their order, repeated rows included.

    Columns count by name and as text.
    """
    one = F.xxhash64(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0"))) for c in sorted(df.columns)])
    # sums of halves, so that rows that occur twice do not cancel out
    return df.select(one.alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)).alias("low"), F.sum(F.shiftrightunsigned("h", 32)).alias("high"))


def same_content(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two tables have the same rows, as one row with ``same``."""
    x, y = content_hash(a).toDF("n", "low", "high"), content_hash(b).toDF("m", "low2", "high2")
    return x.join(F.broadcast(y), F.lit(True)).select((F.col("n").eqNullSafe(F.col("m")) & F.col("low").eqNullSafe(F.col("low2")) & F.col("high").eqNullSafe(F.col("high2"))).alias("same"))
