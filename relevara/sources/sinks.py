"""Writers of catalogues, uploads, result tables and caches, and the shared folder that queries write to."""

from __future__ import annotations

import gc
import os
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLAIN = re.compile(r"[A-Za-z0-9_-][A-Za-z0-9._-]*")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for all its machines; a temporary one only on a local master."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = "file://" + tempfile.mkdtemp(prefix="relevara-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing holds any more: it does so when the driver's JVM collects garbage, by itself perhaps hours later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_KEPT: dict[tuple[str, str, str], str] = {}


def kept(spark: SparkSession, name: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` gives, written once for each name and key of a session; made again if its folder is gone."""
    at = (spark.sparkContext.applicationId, name, key)
    if at not in _KEPT or not exists(spark, f"{_KEPT[at]}/_SUCCESS"):
        path = new_path(spark, name)
        build().write.parquet(path)
        _KEPT[at] = path
        tidy(spark)
    return spark.read.parquet(_KEPT[at])


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """The paths of what lies in a folder, without hidden names."""
    at, fs = _at(spark, path)
    found = [(e.getPath().getName(), e.getPath().toString()) for e in fs.listStatus(at)] if fs.exists(at) else []
    return [p for name, p in found if not name.startswith((".", "_"))]


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def write_arrays(spark: SparkSession, df: DataFrame, name: str, order: Sequence[str], folder: str, suffix: str = "_judged", gzip: bool = False, pretty: bool = False) -> list[str]:
    """One file for each value of ``name`` with a JSON array of its rows in order, ``<value><suffix>.json``, with .gz if packed; returns the paths.

    A file is one task's, as one file has one writer; rows are objects of all columns but ``name``.
    """
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    own = Window.partitionBy(name).orderBy(*order)
    body = F.to_json(F.struct(*[c for c in df.columns if c != name]), {"ignoreNullFields": "false", **({"pretty": "true"} if pretty else {})})
    n = F.count("*").over(Window.partitionBy(name))
    nth = F.row_number().over(own)
    line = F.concat(F.when(nth == 1, "[").otherwise(","), body, F.when(nth == n, "]").otherwise(""))
    lines = df.select(F.col(name).alias("_name"), nth.alias("_nth"), line.alias("value")).repartition("_name").sortWithinPartitions("_name", "_nth").select("_name", "value")
    parts = f"{folder}/parts-{uuid.uuid4().hex}"
    lines.write.option("compression", "gzip" if gzip else "none").partitionBy("_name").text(parts)
    end, out = ".json.gz" if gzip else ".json", []
    at, fs = _at(spark, parts)
    for entry in fs.listStatus(at):
        if entry.isDirectory():
            value = unquote(entry.getPath().getName().partition("=")[2])
            files = [f.getPath() for f in fs.listStatus(entry.getPath()) if f.getPath().getName().startswith("part-")]
            out.append(f"{folder}/{value}{suffix}{end}")
            fs.rename(files[0], _at(spark, out[-1])[0])
    delete(spark, parts)
    return sorted(out)


#: Files of a folder of ``write_files``.
FOLDER = 2000


def put_files(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """(bucket, name, value) as files below ``root``, each whole or not there; the number of files."""
    for b in batches:
        for bucket, name, value in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if not PLAIN.fullmatch(name):
                raise ValueError(f"no name for a file: {name!r}")
            folder = f"{root}/bucket={bucket}"
            os.makedirs(folder, exist_ok=True)
            part = f"{folder}/.{name}-{uuid.uuid4().hex}"
            with open(part, "w", encoding="utf-8", newline="") as f:
                f.write(value + "\n")
            os.replace(part, f"{folder}/{name}.json")
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])


def write_files(spark: SparkSession, df: DataFrame, name: str, value: str, folder: str, rows: int) -> None:
    """One text file for each row of ``df``, called by ``name``, in folders ``bucket=<n>`` of about FOLDER files for ``rows`` rows.

    Names differ and are plain (letters, digits, dots, dashes).  Files of a mounted folder are written by Python, as Hadoop starts
    processes for the rights of each local file; elsewhere Spark writes a folder ``file=<name>`` with the one file.
    """
    buckets = max(1, -(-rows // FOLDER))
    tasks = max(1, min(8 * spark.sparkContext.defaultParallelism, -(-rows // 500)))
    named = df.select(F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(buckets)).alias("bucket"), F.col(name).cast("string").alias("name"), F.coalesce(F.col(value), F.lit("")).alias("value")).repartition(tasks, "name")
    _, fs = _at(spark, folder)
    if fs.getScheme() != "file":
        named.withColumnRenamed("name", "file").write.partitionBy("bucket", "file").text(folder)
        return
    root = unquote(urlparse(folder).path)
    os.makedirs(root)
    named.mapInArrow(lambda it: put_files(it, root), "n long").agg(F.sum("n")).collect()


def write_catalogue(df: DataFrame, columns: Sequence[str], path: str) -> None:
    """Parquet with exactly these columns in this order."""
    df.select(*columns).write.mode("overwrite").parquet(path)


def write_sample(df: DataFrame, order: Sequence[str], path: str, rows: int = 300) -> None:
    """CSV of the first rows in a stated order."""
    df.orderBy(*order).limit(rows).write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """All columns, nulls included, one object per line."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def keyed_lines(df: DataFrame, key: str) -> DataFrame:
    """One text line per row: the key, and the other columns as its object; lines in order of the keys."""
    rest = [c for c in df.columns if c != key]
    return df.orderBy(key).select(F.to_json(F.create_map(F.col(key).cast("string"), F.struct(*rest)), {"ignoreNullFields": "false"}).alias("value"))


def write_keyed(df: DataFrame, key: str, path: str) -> None:
    """An upload keyed by id as JSON lines, so that no task holds the whole object."""
    keyed_lines(df, key).write.mode("overwrite").text(path)


def fixed(x: Column, digits: int = 6) -> Column:
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def write_table(df: DataFrame, path: str, order: Sequence[str], digits: int | None = None) -> None:
    """A small result table as one sorted CSV file; with ``digits`` all doubles have so many decimals."""
    kinds = dict(df.dtypes)
    cols = [fixed(F.col(c), digits).alias(c) if digits is not None and kinds[c] == "double" else F.col(c) for c in df.columns]
    df.orderBy(*order).select(*cols).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_finished(df: DataFrame, path: str, by: str) -> None:
    """Finished queries as partitions of their own: writing one again replaces it and leaves all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_once(spark: SparkSession, df: DataFrame, key: str, good: Column, path: str) -> DataFrame:
    """Adds rows whose key the cache hasn't, the failed ones to a folder of their own; returns the cache.

    A key that failed before is tried again; one that is cached stays as it is.
    """
    done, failed = f"{path}/done", f"{path}/failed"
    try:
        known = spark.read.schema(df.schema).parquet(done)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = df.limit(0)
    new = df.join(known.select(key).distinct(), key, "left_anti").select(*df.columns)
    new.filter(~good).write.mode("overwrite").parquet(failed)
    new.filter(good).write.mode("append").parquet(done)
    return spark.read.schema(df.schema).parquet(done)


# functions go to the executors by value, which need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
