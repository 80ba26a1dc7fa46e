"""Session helpers shared by the operators: written tables, Arrow batch limits, size-checked joins."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

from relevara.sources.sinks import shared_folder

#: Rows that a side may have to be broadcast; beyond it the join shuffles both sides.
BROADCAST_ROWS = 200_000
#: Bytes that it may have.
BROADCAST_BYTES = 16 << 20


def ship(module: str) -> None:
    """Send a module's functions to the executors by value, so that they need no copy of the library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def text_session(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that carry whole texts: few rows, so that long texts fit in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of an Arrow batch for the jobs that run inside; the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = f"{shared_folder(spark)}/relevara-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._relevara_path = path
    return out


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._relevara_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def width(kind: DataType) -> int | None:
    """Bytes of a value of fixed size; None if sizes differ."""
    if isinstance(kind, StructType):
        parts = [width(f.dataType) for f in kind.fields]
        return None if None in parts else 8 + sum(parts)
    return None if isinstance(kind, (ArrayType, MapType, StringType, BinaryType)) else 8


def checked(small: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``small`` with a broadcast hint if it has at most ``limit`` rows (counted here unless given) and ``most`` bytes."""
    n = rows if rows is not None else small.limit(limit + 1).count()
    if n > limit:
        return small
    size = width(small.schema)
    if size is None:  # as JSON, which is longer than the values
        size = small.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    else:
        size *= n
    return F.broadcast(small) if size <= most else small


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def released(out: Iterator) -> Iterator:
    """What a task yields; when it ends, memory that its arrays have left goes back to the machine instead of staying with an idle worker."""
    try:
        yield from out
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim:
            trim(0)


def keyed(docs: DataFrame) -> DataFrame:
    """(row, key_id, key_hash): whole rows, so that no name clashes, told by doc_id and the hash of the text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("key_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key_hash"))


def same_key(side: DataFrame) -> Column:
    """Whether a row of ``keyed`` is that of ``side`` (doc_id, text_hash)."""
    return F.col("key_id").eqNullSafe(side["doc_id"]) & (F.col("key_hash") == side["text_hash"])


def drop_rows(spark: SparkSession, docs: DataFrame, fate: DataFrame) -> DataFrame:
    """``docs`` without what ``fate`` (doc_id, text_hash, n_kept) drops; all columns stay.

    Rows that ``fate`` doesn't name stay; of rows that agree in doc_id and text, one stays where
    ``n_kept`` is over 0.
    """
    fate = written(spark, fate.select("doc_id", "text_hash", "n_kept"))
    named = keyed(docs)
    all_ = checked(fate)
    left = named.join(all_, same_key(all_), "left_anti")
    one = fate.filter("n_kept > 0")
    if one.limit(1).count():
        one = checked(one)
        left = left.unionByName(named.join(one, same_key(one), "left_semi").dropDuplicates(["key_id", "key_hash"]))
    return left.select("row.*")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column, mod: int, rest: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == rest


ship(__name__)
