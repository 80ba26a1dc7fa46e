"""Nested JSON of any depth taken apart into a table of nodes by level, pruned, and put together again from the deepest level up.

A node is a row: its document, its path as places in its parents, its name in its parent, and its value as VARIANT.  Each
level is one explode of the containers of the level above; on the way back each container is the list of what its children
have become, in the order of their names or places.  All of it is joins and grouping over columns; there are as many levels as the deepest document has.

Defined cases: null, '' and text that is no JSON give '{}'; what is no object stands under ``value``; null, '', [] and {} are dropped at every depth, and so is a
container that has nothing else; names are sorted by their bytes; of a name that occurs twice the parser decides; numbers are written as Spark
writes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevara.sources.sinks import written

#: Deepest level that is taken apart; Spark's parser accepts no more.
DEEPEST = 1000


def pruned_trees(spark: SparkSession, rows: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, json): the JSON text in ``raw`` of each key without empties and with sorted names; keys are distinct."""
    root = rows.select(F.col(key).alias("doc"), F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("name"), F.try_parse_json(F.nullif(F.col(raw), F.lit(""))).alias("v"))
    levels = [written(spark, kinds(root), "level")]
    while len(levels) <= DEEPEST and levels[-1].filter("kind <> 'scalar'").limit(1).count():
        holders = levels[-1].filter("kind <> 'scalar'").select("doc", "path", "v")
        children = spark.sql("SELECT p.doc, concat(p.path, array(e.pos)) AS path, e.key AS name, e.value AS v FROM {holders} p, LATERAL variant_explode(p.v) e", holders=holders)
        levels.append(written(spark, kinds(children), "level"))
    below = None
    for level in reversed(levels):
        own = level.filter("kind = 'scalar' AND json IS NOT NULL").select("doc", "path", "name", "json")
        if below is not None:
            parts = below.withColumns({"up": F.slice("path", F.lit(1), F.size("path") - 1), "at": F.element_at("path", -1)})
            # a list by place, an object by name; a document's children of one parent are one group, as the document is one row
            joined = parts.groupBy("doc", "up").agg(
                F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNull(), F.struct("at", "json")))), lambda x: x["json"])).alias("items"),
                F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", F.concat(quoted(F.col("name")), F.lit(": "), "json").alias("json"))))), lambda x: x["json"])).alias("fields"),
            )
            holders = level.filter("kind <> 'scalar'").select(F.col("doc").alias("d"), F.col("path").alias("p"), "name", "kind")
            made = holders.join(joined, (F.col("d") == F.col("doc")) & (F.col("p") == F.col("up")))
            text = F.when(F.col("kind") == "list", F.concat(F.lit("["), "items", F.lit("]"))).otherwise(F.concat(F.lit("{"), "fields", F.lit("}")))
            own = own.unionByName(made.select("doc", F.col("p").alias("path"), "name", text.alias("json")))
        below = written(spark, own, "level")
    top = levels[0].select(F.col("doc").alias("d"), "kind").join(below.select("doc", "json"), F.col("d") == F.col("doc"), "left")
    # a scalar or a list is no object; an empty one is a value all the same
    bare = F.when(F.col("kind") == "list", F.coalesce("json", F.lit("[]"))).otherwise(F.col("json"))
    whole = F.when(F.col("kind") == "object", F.coalesce("json", F.lit("{}"))).when(F.col("kind") == "bad", "{}").otherwise(F.concat(F.lit('{"value": '), F.coalesce(bare, F.lit("null")), F.lit("}")))
    flat = rows.select(F.col(key).alias("k"), try_kind(F.col(raw)).alias("bad_kind"))
    return top.join(flat, F.col("d") == F.col("k")).select(F.col("d").alias(key), F.when(F.col("bad_kind"), "{}").otherwise(whole).alias("json"))


def try_kind(raw):
    """Whether a text is no JSON."""
    return F.coalesce(raw, F.lit("")).eqNullSafe(F.lit("")) | F.try_parse_json(raw).isNull()


def quoted(text):
    """A text as a JSON string: a list of it without its brackets."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def kinds(nodes: DataFrame) -> DataFrame:
    """Nodes with their kind, and the JSON of scalars, null where they are empty."""
    schema = F.schema_of_variant("v")
    kind = F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "list").otherwise("scalar")
    text = F.to_json("v")
    return nodes.withColumn("kind", kind).withColumn("json", F.when((kind == "scalar") & ~F.is_variant_null("v") & (text != '""'), text))
