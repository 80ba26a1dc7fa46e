"""The forest of random-projection trees against brute force: exact scores, recall, awkward rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relevara.llm import projection_forest as forest
from relevara.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, id long, data string"


def brute(rows, asks, k, kind=np.float32):
    """Each query's k nearest by cosine in doubles, ties to the smaller id."""
    fine = [(i, np.array(x, kind).astype(float)) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    dim = max((len(x) for _, x in fine), default=0)
    fine = [(i, np.pad(x, (0, dim - len(x)))) for i, x in fine if np.any(x)]
    fine = [(i, np.ldexp(x, -np.frexp(np.abs(x).max())[1])) for i, x in fine]
    out = {}
    for q, x in fine:
        if not asks(q):
            continue
        best = out.setdefault(q, {})
        for i, y in fine:
            if i != q:
                s = float(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)))
                best[i] = max(best.get(i, -9.0), round(s, 10))
    return {q: sorted(((i, s) for i, s in best.items()), key=lambda t: (-t[1], t[0]))[:k] for q, best in out.items()}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got = out.setdefault(r.query_id, [])
        assert r["rank"] == len(got) + 1
        got.append((r.vec_id, round(r.score, 10)))
    return out


def test_one_leaf_is_exact(spark):
    """Below the size of a leaf all rows are candidates: nulls, zeros, infinities, copies, short and huge vectors, ids twice."""
    rnd = random.Random(4)
    vec = lambda n=6: [rnd.gauss(0, 1) for _ in range(n)]
    rows = [(i, vec()) for i in range(60)] + [(100, None), (101, []), (102, [0.0] * 6), (103, [1.0, None]), (104, [float("nan")] * 6), (105, [float("inf"), 1.0]), (None, vec())]
    rows += [(i, rows[3][1]) for i in (110, 120, 130, 140, 150, 160, 170, 180)] + [(3, rows[3][1])] * 4 + [(10, vec()), (200, vec(3)), (210, [1e30, 2e30, -1e30]), (220, [1e-30, 2e-30, -1e-30]), (230, [2.0, 0.0]), (240, [4.0])]
    docs = spark.createDataFrame([(i, x, 1, 5, "x") for i, x in rows], SCHEMA)
    assert found(forest.forest_search(spark, docs.repartition(3), F.col("vec_id") % 10 == 0)) == brute(rows, lambda i: i % 10 == 0, 5)
    few = spark.createDataFrame([(10, [1.0, 2.0], 1, 5, "x"), (11, [1.0, 2.5], 1, 5, "x"), (12, [1.0, 0.0], 1, 5, "x")], SCHEMA)
    assert [len(v) for v in found(forest.forest_search(spark, few, F.col("vec_id") == 10)).values()] == [2]
    assert forest.forest_search(spark, few.limit(0), F.lit(True)).collect() == []
    assert forest.forest_search(spark, few, F.lit(False)).collect() == []
    double = spark.createDataFrame([(i, [1e200 * (i + 1), 1e200, 3.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert found(forest.forest_search(spark, double, F.col("vec_id") == 0)) == brute([(i, [1e200 * (i + 1), 1e200, 3.0]) for i in range(9)], lambda i: i == 0, 5, float)


@pytest.mark.parametrize("kind", ["sphere", "clusters"])
def test_recall_with_many_leaves(spark, kind):
    """Random directions are the hardest case; half of the other table is one vector, a cluster and copies."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 24)).astype(np.float32)
    if kind == "clusters":
        x = (rng.normal(size=(40, 24))[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 24))).astype(np.float32)
        x[3000:] = x[7]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    docs = spark.createDataFrame([(i, v, 1, 5, "x") for i, v in rows], SCHEMA)
    got = found(forest.forest_search(spark, docs, F.col("vec_id") % 50 == 0, leaf=256))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = n = 0
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -9
        kth = np.sort(s)[-5]
        assert len(got[q]) == 5
        hits += sum(s[i] >= kth - 1e-9 for i, _ in got[q])
        n += 5
        for i, score in got[q]:
            assert abs(score - s[i]) < 1e-9
    assert hits / n >= 0.9, hits / n
    if kind == "clusters":  # ties to the smaller id
        assert [i for i, _ in got[4000]] == [7, 3000, 3001, 3002, 3003]


def test_leaves_of_the_queue_are_those_a_heap_pops():
    import heapq

    rng = np.random.default_rng(3)
    x = forest.unit(rng.normal(size=(4000, 16)))
    f = forest.Forest(x, 5, 3, 5, 0.9)
    q = x[:20]
    p, first = f.projected(q), f.first(q)
    for i in range(len(q)):
        heap, leaves = [(0.0, t, 0, 0) for t in range(f.trees)], []
        while len(leaves) < f.visits:
            cost, t, level, node = heapq.heappop(heap)
            if level == f.depth:
                leaves.append(t * f.leaves + node)
                continue
            m = p[i, t, level] - f.cuts[t][level][node]
            heapq.heappush(heap, (cost + max(m, 0) ** 2, t, level + 1, node * 2))
            heapq.heappush(heap, (cost + max(-m, 0) ** 2, t, level + 1, node * 2 + 1))
        assert sorted(leaves) == sorted(first[i].tolist())


def test_query_recall_on_the_small_tables(spark):
    got = found(queries.op11_nearest_neighbours(spark, "/root/testdata/sf0.1"))
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    t = t[[e is not None and all(c is not None and np.isfinite(c) for c in e) and np.any(e) for e in t["embedding"]]]
    u = np.stack(t["embedding"].to_list()).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    ids, hits = t["vec_id"].to_numpy(), 0
    asked = [i for i, v in enumerate(ids) if v % 50 == 0]
    for i in asked:
        s = u @ u[i]
        s[ids == ids[i]] = -9
        hits += sum(v in set(ids[np.argsort(-s)[:5]]) for v, _ in got[ids[i]])
    assert len(got) == len(asked) and hits / (5 * len(asked)) >= 0.9


def test_the_sample_sends_the_driver_no_more_rows_with_more_tasks(spark, monkeypatch):
    """64 tasks of 512 rows each would send all 32,768 rows; what tasks may send is bounded here."""
    monkeypatch.setattr(forest, "SAMPLE", 512)
    wide = ", ".join("rand({}) - 0.5".format(i) for i in range(64))
    vectors = spark.range(32_768, numPartitions=64).selectExpr("id AS vec_id", f"CAST(array({wide}) AS array<float>) AS embedding")
    conf = spark.sparkContext._jsc.sc().conf()
    before, parts = conf.get("spark.driver.maxResultSize", "1g"), spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        conf.set("spark.driver.maxResultSize", "3m")
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "160k")
        spark.conf.set("spark.sql.files.openCostInBytes", "64k")
        got = found(forest.forest_search(spark, vectors, F.col("vec_id") % 4096 == 0))
    finally:
        conf.set("spark.driver.maxResultSize", before)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == list(range(0, 32_768, 4096)) and all(len(x) == 5 for x in got.values())


def test_drawn_rows_are_those_of_the_smallest_hashes(spark):
    """Also where most rows are of one id, and where there are fewer rows than wanted."""
    rows = spark.range(9000).select((F.col("id") * F.when(F.col("id") < 3000, 1).otherwise(0)).alias("id"), F.encode(F.col("id").cast("string"), "utf-8").alias("data"))
    order = [(r.id, bytes(r.data)) for r in rows.orderBy(F.xxhash64("id", "data")).collect()]
    for want in (1, 40, 700, 9000, 20_000):
        assert [(r.id, bytes(r.data)) for r in forest.drawn_rows(rows, 9000, want).collect()] == order[:want]


def test_rows_of_queries_are_not_broadcast(spark, monkeypatch):
    """A few queries become many rows, one for each leaf; Spark doesn't see that and must not send them to all."""
    plans, keep = [], forest.written

    def noted(s, df):
        if df.columns == ["query_id", "vec_id", "score"]:
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(s, df)

    monkeypatch.setattr(forest, "written", noted)
    rnd = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rnd.normal(size=(3000, 8)))], "vec_id long, embedding array<double>")
    assert forest.forest_search(spark, docs, F.col("vec_id") % 50 == 0, leaf=64).count() == 300
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0].partition("Initial Plan")[0]
