"""Judging runs, budgets, JSON arrays cut in blocks, shared draws and second paths, on small tables against plain code."""

import gzip
import json
import math
import os
import random
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from relevara.operators import judge, resampling, running
from relevara.plans import evaluation
from relevara.sources import json_arrays, readers, sinks

DATA = "/root/testdata/sf0.001"
ITEMS = f"call_id string, query string, tier string, items array<{judge.ITEM}>"


@dataclass(frozen=True)
class Noted:
    """Writes down each call; fails as its query says: busy for some attempts, with pictures, always, or not."""

    log: str
    dies: bool = False

    def ask(self, call):
        if self.dies and call.call_id == "c7":
            os._exit(1)  # the worker dies as it does with its machine
        with open(f"{self.log}/{call.call_id}-{call.attempt}-{int(call.with_images)}-{random.randrange(10**9)}", "w"):
            pass
        kind, _, n = call.query.partition(":")
        if kind == "busy" and call.attempt <= int(n):
            raise RuntimeError("503 service unavailable")
        if kind == "picture" and call.with_images or kind == "never":
            raise ValueError("bad picture")
        if kind == "words":
            return "nothing to see", 5
        return json.dumps([{"index": i["item"], "label": "exact"} for i in call.items[: 1 if kind == "half" else None]] * 2), 5


cloudpickle.register_pickle_by_value(__import__(__name__))


def calls(spark, kinds):
    item = lambda i, image: (i, f"p{i}", "t", None, None, None, image)
    return spark.createDataFrame([(f"c{k}", q, "simple", [item(1, True), item(2, False)] if q else []) for k, q in enumerate(kinds)], ITEMS)


def asked(log):
    return sorted(f.rsplit("-", 1)[0] for f in os.listdir(log))


def test_judging_in_rounds(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    kinds = ["fine", "busy:1", "busy:3", "busy:9", "picture", "never", "half", "words", ""]
    out = judge.judged(spark, calls(spark, kinds), Noted(str(log)), f"file://{tmp_path}/run").collect()
    got = {(r.call_id, r.product_id): (r.label, r.failed, r.attempts, r.with_images, r.status) for r in out}
    ok = lambda n, image: ("Exact", False, n, image, "ok")
    bad = lambda n, image: ("Irrelevant", True, n, image, "failed")
    assert got == {
        **{(c, p): v for c, v in {"c0": ok(1, True), "c1": ok(2, True), "c2": ok(4, True), "c3": bad(4, False), "c4": ok(2, False), "c5": bad(4, False), "c7": bad(4, False)}.items() for p in ("p1", "p2")},
        ("c6", "p1"): ok(1, True),
        ("c6", "p2"): bad(1, True),
    }
    assert all((r.reasoning == "judge failed after retries") == r.failed for r in out)
    # transient failures keep the pictures, others try without; each attempt is one call
    want = ["c0-1-1", "c1-1-1", "c1-2-1", *[f"c2-{i}-1" for i in range(1, 5)], *[f"c3-{i}-1" for i in range(1, 5)], "c4-1-1", "c4-2-0", "c5-1-1", *[f"c5-{i}-0" for i in (2, 3, 4)], "c6-1-1", "c7-1-1", *[f"c7-{i}-0" for i in (2, 3, 4)], "c8-1-0"]
    assert asked(log) == sorted(want)
    judge.judged(spark, calls(spark, kinds), Noted(str(log)), f"file://{tmp_path}/run").collect()
    assert asked(log) == sorted(want)  # a run over the same folder asks nothing again


def test_a_killed_run_is_taken_up(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    run = f"file://{tmp_path}/run"
    table = calls(spark, ["fine"] * 40)
    with pytest.raises(Exception, match=r"(?i)crashed|exited|lost|EOF|abort"):
        judge.judged(spark, table, Noted(str(log), dies=True), run, wave=10).collect()
    before = asked(log)
    out = judge.judged(spark, table, Noted(str(log)), run, wave=10).collect()
    assert len(out) == 80 and all(r.status == "ok" for r in out)
    waves = {r.call_id: r.wave for r in spark.read.parquet(f"{run}/round-1/calls").collect()}
    twice = {c for c in asked(log) if asked(log).count(c) > 1}
    # only calls of the wave in which the worker died may have been in flight
    assert len(before) < 40 and {waves[c.split("-")[0]] for c in twice} <= {waves["c7"]}


def test_tasks_follow_the_pace_of_the_judge(spark, tmp_path):
    """Of a quick judge later waves are a few tasks, each with more calls; of a slow one tasks keep few calls."""
    kinds = ["one word"] * 1200
    out = judge.judged(spark, calls(spark, kinds), judge.RuleJudge(), f"file://{tmp_path}/run", wave=600)
    assert out.count() == 2400
    plan = {r.wave: r["count"] for r in spark.read.parquet(f"{tmp_path}/run/round-1/calls").groupBy("wave").count().collect()}
    files = [sum(f.startswith("part-") for f in os.listdir(f"{tmp_path}/run/round-1/answers-{w}")) for w in (0, 1)]
    assert files[0] == -(-plan[0] // judge.CALLS) and files[1] < files[0] / 2
    pace = judge.Pace()
    assert pace.tasks(1600, 4) == 100 and pace.tasks(20, 4) == 2 and pace.tasks(0, 4) == 1
    pace.took(1600, 1600 * 3.0)
    assert pace.tasks(1600, 4) == 100
    pace.took(1600, 1600 * 0.1)
    assert pace.tasks(1600, 4) == 16 and pace.tasks(160, 4) == 4
    pace.took(1600, 0.0)
    assert pace.calls == judge.MOST_CALLS


def test_a_run_stops_at_its_budget(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    out = judge.judged(spark, calls(spark, ["fine"] * 60), Noted(str(log)), f"file://{tmp_path}/run", wave=10, budget=100).collect()
    n = len(asked(log))
    assert 20 < n < 60 and sum(r.status == "aborted" for r in out) == 2 * (60 - n) and sum(r.status == "ok" for r in out) == 2 * n
    (tmp_path / "log2").mkdir()
    out = judge.judged(spark, calls(spark, ["never"] * 9), Noted(str(tmp_path / "log2")), f"file://{tmp_path}/run2", most_failures=3).collect()
    assert {r.status for r in out} == {"aborted"}
    assert judge.judged(spark, calls(spark, []), Noted(str(log)), f"file://{tmp_path}/run3").collect() == []


def test_rule_judge():
    rule = judge.RuleJudge()
    call = judge.Call("1", "red wool hat", "simple", [{"item": 1, "title": "Red wool hat", "description": None}, {"item": 2, "title": "red hat"}, {"item": 3, "title": None}, {"item": 4, "title": "wool"}], 1, False)
    text, cost = rule.ask(call)
    assert [r["label"] for r in json.loads(text.partition(": ")[2])] == ["Exact", "Substitute", "Irrelevant", "Complementary"] and cost > 0


def test_budget_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(running, "ROWS", 40)
    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, *range(20)]), rnd.choice([None, 0, 3, 50]), rnd.random() < 0.1, rnd.choice([True, False, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, turn int, cost int, failed boolean, cached boolean")
    for budget, most in ((2000, 99), (10**6, 7), (0, 0), (10**6, 10**6)):
        spent = failures = 0
        want = {}
        for i, _, cost, failed, cached in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
            over = spent > budget or failures > most
            want[i] = (spent, failures, "cached" if cached else "aborted" if over else "failed" if failed else "ok")
            spent, failures = spent + (0 if cached else cost or 0), failures + (0 if cached else failed)
        out = running.budgeted(spark, df, ["turn", "id"], budget, most)
        assert {r.id: (r.spent_before, r.failed_before, r.status) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition" not in plan
    assert running.budgeted(spark, df.limit(0), ["id"], 1, 1).collect() == []
    with pytest.raises(ValueError, match="_range"):
        running.budgeted(spark, df.withColumn("_range", F.lit(1)), ["id"], 1, 1)


def odd_value(rnd, depth=0):
    text = lambda: "".join(rnd.choice(['"', "\\", "}", "{", "[", "]", ",", "a", "é", "\n", " ", "\U0001f600"]) for _ in range(rnd.randrange(12)))
    kind = rnd.randrange(6 if depth < 3 else 3)
    if kind < 2:
        return text()
    if kind == 2:
        return rnd.choice([None, True, 1.5, -3])
    if kind < 5:
        return {text(): odd_value(rnd, depth + 1) for _ in range(rnd.randrange(4))}
    return [odd_value(rnd, depth + 1) for _ in range(rnd.randrange(4))]


@pytest.mark.parametrize("size", [40, 333, 1 << 20])
def test_json_arrays_in_blocks(spark, tmp_path, size, monkeypatch):
    rnd = random.Random(size)
    monkeypatch.setattr(json_arrays, "STEP", 50 if size == 40 else 1 << 20)
    files = {"a.json": [odd_value(rnd) for _ in range(60)], "b.json": [], "c.json": ["x" * 3000, {"a": "[" * 500}, [1, [2]], 7, '"}]'], "d.json": [{"k": odd_value(rnd)} for _ in range(30)]}
    (tmp_path / "a.json").write_text(json.dumps(files["a.json"]))
    (tmp_path / "b.json").write_text(" [ ]\n")
    (tmp_path / "c.json").write_text("\n " + json.dumps(files["c.json"], indent=3, ensure_ascii=False) + "\n\n")
    (tmp_path / "d.json").write_text("\n".join(json.dumps(x) for x in files["d.json"]) + "\n")  # objects, no array
    (tmp_path / "e.json").write_text(json.dumps(files["d.json"][0], indent=1))  # one object
    (tmp_path / "f.json").write_text("")
    with gzip.open(tmp_path / "g.json.gz", "wt") as f:
        json.dump(files["a.json"], f, indent=2)
    want = {**files, "e.json": files["d.json"][:1], "g.json.gz": files["a.json"]}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = json_arrays.elements(spark, str(tmp_path), parts=5).collect()
        # with a block size below that of the file the file feeds many tasks
        parts = json_arrays.elements(spark, str(tmp_path / "a.json")).select(F.spark_partition_id()).distinct().count()
        blocks = spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    got = {}
    for r in rows:
        got.setdefault(r.file.rpartition("/")[2], []).append(json.dumps(json.loads(r.element), sort_keys=True))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(json.dumps(x, sort_keys=True) for x in v) for k, v in want.items() if v}
    assert size > 1000 or (blocks > 3 and parts > 1)


def test_array_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("auto", "q1", "x"), ("auto", "q2", None), ("home", "q3", 'a "b" ] }')], "sector string, query_id string, text_query string")
    plain = sinks.write_arrays(spark, rows, "sector", ["query_id"], f"file://{tmp_path}/plain", pretty=True)
    packed = sinks.write_arrays(spark, rows, "sector", ["query_id"], f"file://{tmp_path}/packed", gzip=True)
    assert [p.rpartition("/")[2] for p in plain + packed] == ["auto_judged.json", "home_judged.json", "auto_judged.json.gz", "home_judged.json.gz"]
    assert json.loads((tmp_path / "plain" / "auto_judged.json").read_text()) == [{"query_id": "q1", "text_query": "x"}, {"query_id": "q2", "text_query": None}]
    for paths in (plain, packed):
        out = readers.sector_files(spark, paths).select("sector", "query_id", "text_query")
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.collect()))


def test_shared_draws_against_a_plain_version(spark, monkeypatch):
    """Each total of each replicate, from counts made here; two streams, one of several parts; the spread is that of resampling."""
    monkeypatch.setattr(resampling, "PART", 100)
    rng = np.random.default_rng(1)
    diffs = {"a": rng.integers(-(10**9), 10**9, (420, 3)), "b": rng.integers(-5, 6, (30, 3))}
    rows = spark.createDataFrame([(s, i, [int(c) for c in x]) for s, m in diffs.items() for i, x in enumerate(m)], "stream string, query_id int, diffs array<long>")
    boot = resampling.resampled(spark, rows, 600, 7)
    got = {(r.stream, r.rep, r.test): (r.total, r.n) for r in boot.collect()}
    assert len(got) == 2 * 600 * 3
    part = {(r.stream, r.query_id): r.p for r in rows.select("stream", "query_id", F.pmod(F.xxhash64("query_id"), F.when(F.col("stream") == "a", 5).otherwise(1)).alias("p")).collect()}
    for s, m in diffs.items():
        n = 5 if s == "a" else 1
        members = [[i for i in range(len(m)) if part[s, i] == p] for p in range(n)]
        sizes = np.array([len(x) for x in members])
        for block in range(3):
            size = min(resampling.BLOCK, 600 - block * resampling.BLOCK)
            total = np.zeros((size, 3), np.int64)
            drawn = np.zeros(size, np.int64)
            for p in range(n):
                for r, counts in enumerate(resampling.block_counts(7, s, block, size, sizes, p)):
                    drawn[r] += counts.sum()
                    total[r] += sum(int(c) * m[i] for c, i in zip(counts, members[p], strict=True))
            assert (drawn == len(m)).all()
            for r in range(size):
                for t in range(3):
                    assert got[s, block * resampling.BLOCK + r, t] == (total[r, t], len(m))
    means = np.array([got["a", r, 0][0] / 420 for r in range(600)])
    assert abs(means.std() / (diffs["a"][:, 0].std() / math.sqrt(420)) - 1) < 0.1 and abs(means.mean() - diffs["a"][:, 0].mean()) < 4 * means.std() / math.sqrt(600)
    # the tests of a stream share their draws
    assert abs(np.corrcoef(means, [got["a", r, 1][0] / 420 for r in range(600)])[0, 1] - np.corrcoef(diffs["a"][:, 0], diffs["a"][:, 1])[0, 1]) < 0.15
    zero = spark.createDataFrame([("z", i, [0, i - 1]) for i in range(3)], "stream string, query_id int, diffs array<long>")
    assert {r.test: r.p_raw for r in resampling.tested(resampling.resampled(spark, zero, 50)).collect()}[0] == 1.0


def test_families_have_their_sizes(spark):
    tests = evaluation.family_tests(spark, DATA, 500).toPandas()
    assert len(tests) == 236 and (tests["n_replicates"] == 500).all() and tests["source"].value_counts().to_dict() == {"original_grid": 128, "corrected_ndcg": 64, "ezr": 44}
    assert ((tests["ci_low"] <= tests["observed_diff"] + 0.05) & (tests["ci_high"] >= tests["observed_diff"] - 0.05)).all()
    seen = evaluation.st6_observed(spark, DATA).toPandas().merge(tests, on=["metric", "slice", "engine"])
    assert len(seen) == 236 and np.allclose(seen["observed_diff_x"], seen["observed_diff_y"], atol=2e-6)


def test_equality_of_two_paths_can_fail(spark):
    cells = [("overall", "focal", "ndcg10", 10, 0.5), ("overall", "focal", "p10", 10, 0.25)]
    frame = lambda rows: spark.createDataFrame(rows, "slice string, engine string, metric string, n long, value double")
    passes = lambda other: {r.metric: r.passes for r in evaluation.equality(frame(cells), frame(other)).collect()}
    assert passes(cells) == {"ndcg10": True, "p10": True}
    assert passes([cells[0], (*cells[1][:4], 0.25 + 2e-9)]) == {"ndcg10": True, "p10": False}
    assert passes([(*cells[0][:3], 9, 0.5), cells[1]]) == {"ndcg10": False, "p10": True}
    assert passes(cells[:1]) == {"ndcg10": True, "p10": False}


def test_parts_travel_once(spark):
    """The lists of a part are not copied for each block of replicates."""
    rows = spark.range(300).select(F.lit("a").alias("stream"), F.col("id").alias("query_id"), F.array(F.col("id") % 5 - 2).alias("diffs"))
    boot = resampling.resampled(spark, rows, 1000)
    assert boot.count() == 1000 and "Generate explode(" not in boot._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.rep for r in boot.collect()) == list(range(1000))
