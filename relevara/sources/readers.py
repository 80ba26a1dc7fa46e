"""Readers and writers of the nested judged files and the flat tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevara.sources import sinks
from relevara.sources.json_arrays import elements

HIT = "struct<rank:int,id:string,title:string,description:string,image:string,price:double,discount_price:double,label:string,score:double,reasoning:string,cached:boolean>"
JUDGED = f"query_id string, category string, complexity string, text_query string, providers map<string,struct<latency_ms:double,precision_at_10:double,precision_at_20:double,hits:array<{HIT}>>>"


def judged_files(spark: SparkSession, paths: str | list[str], parts: int | None = None) -> DataFrame:
    """JSON arrays, plain or gzip by suffix, of one or many files, with the file's name; a large file feeds many tasks.

    Elements that are no JSON objects are rows of nulls.  ``parts`` deals the elements of files that cannot be cut (gzip).
    """
    found = elements(spark, paths, parts)
    return found.select(F.from_json("element", JUDGED).alias("j"), F.regexp_extract("file", r"([^/]+)$", 1).alias("file")).select("j.*", "file")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def csv_strings(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header; all columns stay strings, ragged lines are skipped."""
    return spark.read.option("header", True).option("encoding", encoding).option("mode", "DROPMALFORMED").csv(path)


def flattened(judged: DataFrame) -> DataFrame:
    """One row per hit of a judged file: engine, stored position and the hit's fields."""
    own = [c for c in judged.columns if c != "providers"]
    engines = judged.select(*own, F.explode("providers").alias("engine", "result"))
    return engines.select(*own, "engine", F.posexplode("result.hits").alias("position", "hit")).select(*own, "engine", (F.col("position") + 1).alias("position"), "hit.*")


def nested(hits: DataFrame) -> DataFrame:
    """The way back: per query a map of engines to their hits by rank."""
    hit = F.struct(F.col("rank"), F.col("raw_id").alias("id"), F.col("label"))
    per = hits.groupBy("query_id", "sector", "tier", "engine").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    return per.groupBy("query_id", "sector", "tier").agg(F.map_from_entries(F.collect_list(F.struct("engine", "hits"))).alias("providers"))


def sector_files(spark: SparkSession, paths: list[str], suffix: str = "_judged") -> DataFrame:
    """Several judged files as one table, with the sector that each file's name begins with."""
    name = F.regexp_replace("file", rf"{suffix}\.json(\.gz)?$", "")
    return judged_files(spark, paths).withColumn("sector", name).drop("file")


def csv_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """CSV as strings: UTF-8 unless it leaves characters that no UTF-8 text has, then Latin-1."""
    utf8 = csv_strings(spark, path)
    broken = None
    for c in utf8.columns:
        bad = F.contains(F.col(f"`{c}`"), F.lit("�"))
        broken = bad if broken is None else broken | bad
    if "�" in "".join(utf8.columns) or broken is not None and utf8.filter(broken).limit(1).count():
        return csv_strings(spark, path, "ISO-8859-1")
    return utf8


#: Folders of ``sinks.write_files`` that are listed and read at once.
FOLDERS = 32
#: The name in the path of a file of ``sinks.write_files``.
NAMED = r"/(?:file=)?([^/=]+?)(?:\.json|/part-[^/]+)$"


def in_portions(spark: SparkSession, folder: str, read: Callable[[str | list[str]], DataFrame]) -> DataFrame:
    """What ``read`` gives of all files below ``folder``; many ``bucket=`` folders are read and written a few at a time, as the driver holds an entry for each file that it reads."""
    inside = sinks.children(spark, folder)
    buckets = sorted(path for path in inside if path.rpartition("/")[2].startswith("bucket="))
    if len(buckets) <= FOLDERS:
        return read(folder)
    others = sorted(set(inside) - set(buckets))
    portions = [buckets[i : i + FOLDERS] for i in range(0, len(buckets), FOLDERS)] + ([others] if others else [])
    path = sinks.new_path(spark, "portions")
    for paths in portions:
        rows = read(paths)
        rows.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def side_files(spark: SparkSession, folder: str, schema: str, key: str = r"([^/]+)\.json$") -> DataFrame:
    """(key, side): one JSON file per key, named by it (``key`` finds it in the path); a bad file gives null."""

    def portion(paths: str | list[str]) -> DataFrame:
        read = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", "_bad").json(paths)
        fields = [c for c in read.columns if c != "_bad"]
        return read.select(F.regexp_extract("_metadata.file_path", key, 1).alias("key"), F.when(F.col("_bad").isNull(), F.struct(*fields)).alias("side"))

    return in_portions(spark, folder, portion)


def with_side_files(table: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """``table`` with the side file of each row's key, null where there is none."""
    return table.join(side.withColumnRenamed("key", key), key, "left")


REJUDGED = "query_id string, sector string, tier string, model string, product_ids array<string>, labels array<string>, reasonings array<string>, image_missing array<string>, attempts int"


def rejudged(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of re-judgments, one JSON file per query, as one row per product."""
    whole = in_portions(spark, folder, lambda paths: spark.read.schema(REJUDGED).option("multiLine", True).option("recursiveFileLookup", True).json(paths))
    each = F.posexplode(F.arrays_zip("product_ids", "labels", "reasonings"))
    return whole.select("query_id", "sector", "tier", each.alias("position", "j")).select("query_id", "sector", "tier", (F.col("position") + 1).alias("position"), F.col("j.product_ids").alias("product_id"), F.col("j.labels").alias("label"), F.col("j.reasonings").alias("reasoning"))


def typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table of known types."""
    return spark.read.schema(schema).option("header", True).csv(path)
