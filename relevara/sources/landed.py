"""Search results as they were landed, of several shapes, as one table of hits: a data source of its own.

``spark.read.format("landed_search")`` reads folders ``engine=<name>`` of JSON lines, one for each query: query_id, latency_ms,
error and the engine's payload.  What an engine's payload looks like is a row of ``SHAPES``: where its list of
products is, and from which fields each field of a hit comes, the first non-empty one counting.  Files are dealt to tasks by
their bytes; a condition on the engine leaves whole folders out, and only the columns of the schema that is asked for are made.

Paths must be ones that Python can open on every machine.  Options: ``path``; ``shapes``, a JSON object from
engine to shape; ``partitionBytes``.

Defined cases: an engine without a shape has no rows; a blank or broken line is skipped; a line with an error or without products
is a row without a hit (rank 0), so that the query x engine grid stays whole; texts are never null, prices may be.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

HITS = "query_id string, engine string, rank int, id string, title string, subtitle string, description string, image string, url string, price double, discount_price double, score double, latency_ms double, total long, error string"
TEXTS = ("title", "subtitle", "description", "image", "url")
#: Bytes of a task's files.
PARTITION_BYTES = 64 << 20

#: A shape: where the products, ids without products, and the total are; paths of each field; which price was there before.
SHAPES: dict[str, dict[str, Any]] = {
    "nested_documents": {
        "list": "documents", "total": "num_total_results", "id": ["id"], "title": ["metadata.title"], "subtitle": ["metadata.metadata.brand", "metadata.category"],
        "description": ["metadata.description"], "image": ["metadata.images", "metadata.image"], "url": ["metadata.url"], "price": ["metadata.original_price"], "discount_price": ["metadata.discounted_price"], "score": ["score"],
    },
    "flat_objects": {
        "list": "hits", "total": "nb_hits", "id": ["id"], "title": ["title"], "subtitle": ["metadata.brandName", "category"],
        "description": ["description"], "image": ["images"], "url": ["url"], "price": ["original_price"], "discount_price": ["discounted_price"],
    },
    "text_columns": {
        "list": "results", "total": "total", "id": ["id"], "title": ["title"], "subtitle": ["brand", "category"],
        "description": ["description"], "image": ["image_link", "images"], "url": ["link"], "price": ["price"], "discount_price": ["sale_price"], "score": ["score"],
    },
    "attribute_lists": {
        "list": "results.hits", "total": "results.total_hits", "id": ["url"], "title": ["attributes.title"], "subtitle": ["attributes.brand", "attributes.category"],
        "description": ["attributes.description"], "image": ["attributes.image_link", "attributes.images"], "url": ["attributes.web_url"], "before": "attributes.price_old", "now": "attributes.price",
    },
    "parallel_arrays": {
        "list": "product_data", "ids": "result", "total": "count", "id": ["id"], "title": ["name"], "subtitle": ["brand", "category"],
        "description": ["description"], "image": ["image"], "url": ["url"], "before": "list_price", "now": "price",
    },
}


def at(x: Any, path: str) -> Any:
    """The value at a path of names; null where a step is missing."""
    for name in path.split("."):
        x = x.get(name) if isinstance(x, dict) else None
    return x


def one(x: Any) -> Any:
    """The first of a list, also of one that is a text of JSON; anything else as it is."""
    if isinstance(x, str) and x.lstrip().startswith("["):
        try:
            x = json.loads(x)
        except ValueError:
            return None
    return (x[0] if x else None) if isinstance(x, list) else x


def number(x: Any) -> float | None:
    try:
        return None if x is None or isinstance(x, bool) else float(x)
    except (TypeError, ValueError):
        return None


def hit(product: dict[str, Any], shape: dict[str, Any]) -> dict[str, Any]:
    """A product of a payload as a hit."""
    first = lambda name: next((v for v in (one(at(product, p)) for p in shape.get(name, ())) if v not in (None, "")), None)
    out: dict[str, Any] = {name: "" if (v := first(name)) is None else str(v) for name in TEXTS}
    key = first("id")
    out |= {"id": None if key is None else str(key), "score": number(first("score"))}
    if "now" in shape:
        before, now = number(at(product, shape["before"])), number(at(product, shape["now"]))
        return out | {"price": now if before is None else before, "discount_price": None if before is None else now}
    return out | {"price": number(first("price")), "discount_price": number(first("discount_price"))}


def hits(line: dict[str, Any], engine: str, shape: dict[str, Any]) -> Iterator[dict[str, Any]]:
    """The rows of one landed line."""
    payload = line.get("payload")
    products = at(payload, shape["list"]) or [{"id": i} for i in at(payload, shape.get("ids", "")) or []]
    total = at(payload, shape["total"])
    own = {"query_id": str(line.get("query_id")), "engine": engine, "latency_ms": number(line.get("latency_ms")), "error": line.get("error"), "total": int(total) if isinstance(total, int) else len(products)}
    for rank, p in enumerate(products, 1):
        yield own | {"rank": rank} | hit(p if isinstance(p, dict) else {}, shape)
    if not products:
        yield own | {"rank": 0, **dict.fromkeys(TEXTS, "")}


class Files(InputPartition):
    """Files of one task, each with its engine."""

    def __init__(self, files: list[tuple[str, str]]) -> None:
        self.files = files


class LandedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.path = schema, options["path"].removeprefix("file://")
        if "://" in self.path:
            raise ValueError("landed results are read from paths that all machines can open")
        self.shapes = {e: SHAPES[s] for e, s in json.loads(options.get("shapes", "{}")).items()}
        self.bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.engines: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on the engine choose folders; all others are Spark's."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("engine",):
                self.engines = values if self.engines is None else self.engines & values
            else:
                yield f

    def partitions(self) -> Sequence[Files]:
        out: list[Files] = []
        files, size = [], 0
        for engine in sorted(self.shapes):
            folder = os.path.join(self.path, f"engine={engine}")
            if (self.engines is not None and engine not in self.engines) or not os.path.isdir(folder):
                continue
            for name in sorted(os.listdir(folder)):
                if not name.startswith((".", "_")):
                    files.append((engine, os.path.join(folder, name)))
                    size += os.path.getsize(files[-1][1])
                    if size >= self.bytes:
                        out.append(Files(files))
                        files, size = [], 0
        # Spark reads a source without parts as one part, None
        return [*out, Files(files)] if files or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows = to_arrow_schema(self.schema), []
        for engine, path in partition.files:
            with open(path, encoding="utf-8") as f:
                for text in f:
                    try:
                        line = json.loads(text)
                    except ValueError:
                        continue
                    if isinstance(line, dict):
                        rows += [{c: h.get(c) for c in schema.names} for h in hits(line, engine, self.shapes[engine])]
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class LandedSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_search"

    def schema(self) -> str:
        return HITS

    def reader(self, schema: StructType) -> LandedReader:
        return LandedReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with conditions handed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedSearch)


class Registry:
    """Loaders of catalogues by name: the first rule that takes a name has it."""

    def __init__(self) -> None:
        self.rules: list[tuple[Callable[[str], bool], Callable]] = []

    def add(self, takes: Callable[[str], bool] | Sequence[str], load: Callable) -> None:
        self.rules.append((takes if callable(takes) else set(takes).__contains__, load))

    def load(self, name: str, *args: Any, **options: Any) -> Any:
        for takes, load in self.rules:
            if takes(name):
                return load(name, *args, **options)
        raise ValueError(f"nothing loads {name!r}")


# the source goes to the executors by value, which need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
