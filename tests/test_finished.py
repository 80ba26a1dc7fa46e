"""Finished queries as a stream: a killed and restarted run is one run, batches count once, compaction changes nothing."""

import pytest

from relevara.streaming import finished

SCHEMA = "k int, v string"


def rows(spark, path, schema):
    return sorted((r.k is not None, r.k or 0, r.v) for r in finished.current(spark, path, "k", schema).collect())


def land(spark, folder, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


WAVES = [[(1, "a"), (1, "b"), (2, "c"), (None, "n")], [(2, "d"), (3, "e")], [(1, "f"), (None, "m"), (None, "o")], [(4, "g")]]
WANT = [(False, 0, "m"), (False, 0, "o"), (True, 1, "f"), (True, 2, "d"), (True, 3, "e"), (True, 4, "g")]


@pytest.mark.parametrize("dies", [None, 0, 1, 2])
def test_a_killed_stream_goes_on(spark, tmp_path, dies):
    at = f"file://{tmp_path}"
    schema = spark.createDataFrame([], SCHEMA).schema
    assert finished.current(spark, f"{at}/store", "k", schema).collect() == []
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    begun = []

    def die(number):
        begun.append(number)
        if number == dies and begun.count(number) == 1:
            raise RuntimeError("killed after writing")

    for wave in WAVES:
        land(spark, f"{at}/in", wave)
        try:
            finished.keep_finished(stream(), f"{at}/store", f"{at}/checkpoint", die).awaitTermination()
        except Exception as e:
            assert "killed after writing" in str(e)
    finished.keep_finished(stream(), f"{at}/store", f"{at}/checkpoint", die).awaitTermination()
    assert begun == ([0, 1, 2, 3] if dies is None else sorted([0, 1, 2, 3, dies]))
    assert rows(spark, f"{at}/store", schema) == WANT
    finished.compacted(spark, f"{at}/store", "k", schema)
    assert len(finished.parts(spark, f"{at}/store")) == 1 and rows(spark, f"{at}/store", schema) == WANT
    land(spark, f"{at}/in", [(4, "h")])
    finished.keep_finished(stream(), f"{at}/store", f"{at}/checkpoint").awaitTermination()
    assert rows(spark, f"{at}/store", schema) == [*WANT[:-1], (True, 4, "h")]


def test_a_batch_without_its_mark_does_not_count(spark, tmp_path):
    at = f"file://{tmp_path}"
    schema = spark.createDataFrame([], SCHEMA).schema
    spark.createDataFrame([(1, "a")], SCHEMA).write.parquet(f"{at}/store/batch-0")
    spark.createDataFrame([(1, "b")], SCHEMA).write.parquet(f"{at}/store/batch-1")
    (tmp_path / "store" / "batch-1" / "_SUCCESS").unlink()
    assert rows(spark, f"{at}/store", schema) == [(True, 1, "a")]
