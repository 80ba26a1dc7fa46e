"""Finished queries kept as they come in: a stream of judgments whose later rows replace a query's earlier ones.

Each micro-batch is written to a folder of its number.  A batch that runs again after a failure has the same rows and the same
number, by the stream's checkpoint, and so replaces its own half-written folder and nothing else: every batch counts once,
however often it was begun.  The current state takes each key from the last batch that has it; ``compacted`` folds
complete batches into one, so that reading doesn't grow with the number of batches.

Defined cases: a key with several rows in a batch keeps them all, in place of all earlier ones; a null key is a key like any
other; no batch yet is an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from relevara.sources.sinks import _at, delete, exists


def keep_finished(stream: DataFrame, path: str, checkpoint: str, before_commit: Callable[[int], None] | None = None) -> StreamingQuery:
    """Starts the stream over what is there now; ends when all of it is stored.

    ``before_commit`` is called after a batch is written and before the stream commits it.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{number}")
        if before_commit:
            before_commit(number)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parts(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the complete parts in order: the last compaction, and the batches after it."""
    if not exists(spark, path):
        return []
    at, fs = _at(spark, path)
    found = []
    for entry in fs.listStatus(at):
        kind, _, number = entry.getPath().getName().partition("-")
        folder = f"{path}/{kind}-{number}"
        if kind in ("batch", "upto") and exists(spark, f"{folder}/_SUCCESS"):
            found.append((int(number), kind, folder))
    base = max((n for n, kind, _ in found if kind == "upto"), default=-1)
    return sorted((n, f) for n, kind, f in found if (kind == "upto" and n == base) or (kind == "batch" and n > base))


def current(spark: SparkSession, path: str, key: str, schema: StructType) -> DataFrame:
    """The rows of each key from the last batch that has it."""
    rows = None
    for number, folder in parts(spark, path):
        one = spark.read.schema(schema).parquet(folder).withColumn("_batch", F.lit(number))
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        return spark.createDataFrame([], schema)
    last = rows.groupBy(F.col(key).alias("_key")).agg(F.max("_batch").alias("_last"))
    return rows.join(last, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_batch") == F.col("_last"))).select(*schema.names)


def compacted(spark: SparkSession, path: str, key: str, schema: StructType) -> None:
    """Folds all complete batches into one part; what it replaces is deleted only when it is complete."""
    old = parts(spark, path)
    if len(old) > 1:
        last = old[-1][0]
        current(spark, path, key, schema).write.mode("overwrite").parquet(f"{path}/upto-{last}")
        for _, folder in old:
            if folder != f"{path}/upto-{last}":
                delete(spark, folder)
