"""Landed search results and archives on small files: shapes, pushed conditions, pruned columns, broken input."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from relevara.sources import archives, landed, readers, sinks


@pytest.fixture
def folder(tmp_path):
    lines = {
        "a": [
            {"query_id": "q1", "latency_ms": 5, "payload": {"documents": [{"id": 7, "score": "2.5", "metadata": {"title": "T", "metadata": {"brand": ""}, "category": "C", "images": [], "image": "I", "original_price": "9.5"}}, {"id": None}], "num_total_results": 40}},
            {"query_id": "q2", "payload": {}, "error": "503"},
        ],
        "b": [{"query_id": "q1", "payload": {"results": [{"id": "x", "title": None, "brand": "B", "images": '["u", "v"]', "price": "None", "sale_price": "3"}]}}],
        "c": [{"query_id": "q1", "payload": {"results": {"hits": [{"url": "/p/1", "attributes": {"title": "t", "brand": ["m", "n"], "images": "[bad", "price_old": None, "price": 4}}, {"url": "/p/2", "attributes": {"price_old": 9, "price": 4}}], "total_hits": 2}}}],
        "d": [{"query_id": "q1", "payload": {"product_data": [], "result": ["r1", "r2"]}}],
        "e": [{"query_id": "q1", "payload": {"hits": [{"id": "z", "metadata": None, "category": "K", "images": None}]}}],
        "unknown": [{"query_id": "q1", "payload": {"hits": [{"id": "never"}]}}],
    }
    for e, rows in lines.items():
        (tmp_path / f"engine={e}").mkdir()
        for i, r in enumerate(rows):
            (tmp_path / f"engine={e}" / f"part-{i}.txt").write_text("\n" + json.dumps(r) + "\n{broken\n[1]\n")
        (tmp_path / f"engine={e}" / "_SUCCESS").write_text("")
    return str(tmp_path)


SHAPES = json.dumps({"a": "nested_documents", "b": "text_columns", "c": "attribute_lists", "d": "parallel_arrays", "e": "flat_objects", "gone": "flat_objects"})


def reader(spark, folder):
    landed.register(spark)
    return spark.read.format("landed_search").option("shapes", SHAPES).option("partitionBytes", 1).option("path", folder)


def test_five_shapes(spark, folder):
    got = {(r.engine, r.query_id, r["rank"]): r for r in reader(spark, folder).load().collect()}
    short = {k: (r.id, r.title, r.subtitle, r.image, r.price, r.discount_price, r.score, r.total, r.error) for k, r in got.items()}
    assert short == {
        ("a", "q1", 1): ("7", "T", "C", "I", 9.5, None, 2.5, 40, None),
        ("a", "q1", 2): (None, "", "", "", None, None, None, 40, None),
        ("a", "q2", 0): (None, "", "", "", None, None, None, 0, "503"),
        ("b", "q1", 1): ("x", "", "B", "u", None, 3.0, None, 1, None),
        ("c", "q1", 1): ("/p/1", "t", "m", "", 4.0, None, None, 2, None),
        ("c", "q1", 2): ("/p/2", "", "", "", 9.0, 4.0, None, 2, None),
        ("d", "q1", 1): ("r1", "", "", "", None, None, None, 2, None),
        ("d", "q1", 2): ("r2", "", "", "", None, None, None, 2, None),
        ("e", "q1", 1): ("z", "", "K", "", None, None, None, 1, None),
    }


def test_columns_and_folders_are_pruned(spark, folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    from pyspark.sql.types import StructType

    schema = StructType().add("engine", "string").add("rank", "integer")
    one = landed.LandedReader(schema, {"path": folder, "shapes": SHAPES, "partitionbytes": "1"})
    assert len(one.partitions()) == 6  # a file each
    left = list(one.pushFilters([In(("engine",), ("a", "b", "unknown")), GreaterThan(("rank",), 1)]))
    assert len(left) == 1 and sorted(f[0] for p in one.partitions() for f in p.files) == ["a", "a", "b"]
    list(one.pushFilters([EqualTo(("engine",), "b")]))
    assert [b.schema.names for p in one.partitions() for b in one.read(p)] == [["engine", "rank"]]
    rows = reader(spark, folder).schema("engine string, rank int").load().filter("engine = 'c' AND rank > 1")
    assert [tuple(r) for r in rows.collect()] == [("c", 2)]
    assert reader(spark, folder).load().filter("engine = 'nobody'").collect() == []
    with pytest.raises(ValueError, match="all machines"):
        landed.LandedReader(schema, {"path": "hdfs://x/y"})


def test_registry():
    r = landed.Registry()
    r.add(["a", "b"], lambda n, x: ("first", n, x))
    r.add(lambda n: n.startswith("b"), lambda n, x: ("second", n, x))
    assert [r.load(n, 1) for n in ("a", "b", "bc")] == [("first", "a", 1), ("first", "b", 1), ("second", "bc", 1)]
    with pytest.raises(ValueError, match="'c'"):
        r.load("c")


def test_only_chosen_members_are_read(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/x.csv", "h1,h2\r\n" + "é,1\n" * 5 + "last")
        z.writestr("a/y.json", "{}")
        z.writestr("big.bin", b"\0" * 100_000)
        z.mkdir("empty")
        z.writestr("none.csv", "")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    (tmp_path / "other.txt").write_text("x")
    found = archives.archives(spark, str(tmp_path))
    rows = archives.members(found, ["*.csv"]).orderBy("line").collect()
    assert [(r.member, r.n_members, r.line, r.value) for r in rows] == [("a/x.csv", 4, i, v) for i, v in enumerate(["h1,h2", *["é,1"] * 5, "last"])]
    assert archives.members(found, ["x.csv"]).collect() == [] and archives.members(found.limit(0), ["*"]).collect() == []
    # no other member is opened
    opened, real = [], zipfile.ZipFile.open
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, name, *a, **k: opened.append(name) or real(self, name, *a, **k))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["p", "q"]), pa.array([(tmp_path / "one.zip").read_bytes(), None], pa.binary())], names=["path", "content"])
    assert sum(b.num_rows for b in archives.member_batches(iter([batch]), ["*.json"])) == 1 and opened == ["a/y.json"]
    monkeypatch.setattr(archives, "CHUNK", 3)
    assert list(archives.lines_of(io.BytesIO(b"ab\n\ncdefg\nx"))) == [b"ab", b"", b"cdefg", b"x"]


@pytest.mark.parametrize("scheme", ["file", "other"])
def test_files_by_name_are_read_in_portions(spark, monkeypatch, tmp_path, scheme):
    """A file for each row, broken ones too, by Python or by Spark; few folders are listed at once, and none is left out."""
    if scheme != "file":
        plain = sinks._at
        monkeypatch.setattr(sinks, "_at", lambda s, p: (plain(s, p)[0], type("Other", (), {"getScheme": lambda _: "other"})()))
    monkeypatch.setattr(sinks, "FOLDER", 4)
    monkeypatch.setattr(readers, "FOLDERS", 3)
    rows = spark.range(40).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 4 == 0, '{"style": ').otherwise(F.concat(F.lit('{"style": "é'), F.col("id").cast("string"), F.lit('"}'))).alias("value"))
    path = f"file://{tmp_path}/styles"
    sinks.write_files(spark, rows, "id", "value", path, 40)
    monkeypatch.undo() if scheme != "file" else None
    monkeypatch.setattr(readers, "FOLDERS", 3)
    (tmp_path / "styles" / "more.json").write_text('{"style": "m"}')
    read = []
    got = readers.in_portions(spark, path, lambda p: read.append(p) or spark.read.text(p, recursiveFileLookup=True))
    assert got.count() == 41 and len(read) >= 4 and all(len(p) <= 3 for p in read)
    side = {r.key: r.side and r.side.style for r in readers.side_files(spark, path, "style string", readers.NAMED).collect()}
    assert side == {str(i): None if i % 4 == 0 else f"é{i}" for i in range(40)} | {"more": "m"}


def test_names_of_files_are_plain(spark, tmp_path):
    with pytest.raises(Exception, match="no name for a file"):
        sinks.write_files(spark, spark.createDataFrame([("../x", "1")], "id string, value string"), "id", "value", f"file://{tmp_path}/names", 1)
