"""Nested JSON pruned by levels against a recursion over Python values."""

import json
import random

from relevara.functions.trees import pruned_trees


def plain(x):
    if isinstance(x, dict):
        x = {k: plain(v) for k, v in x.items()}
        return {k: v for k, v in x.items() if v not in (None, "", [], {})}
    if isinstance(x, list):
        return [v for v in map(plain, x) if v not in (None, "", [], {})]
    return x


def value(rnd, depth=0):
    kind = rnd.randrange(9 if depth < 4 else 5)
    if kind < 5:
        return rnd.choice(["", None, "a", 'q"u\\é', "tab\tnew\n", 7, -3, True, False, 2.5, " x "])
    if kind < 7:
        return {rnd.choice(["b", "a", 'k"', "é", "Z", "aa"]): value(rnd, depth + 1) for _ in range(rnd.randrange(4))}
    return [value(rnd, depth + 1) for _ in range(rnd.randrange(4))]


def test_trees_against_a_recursion(spark):
    rnd = random.Random(6)
    deep = {}
    for i in range(7):
        deep = {"d": [deep, i]}
    found = [value(rnd) for _ in range(150)] + [deep, [], {}, [[], {}], {"a": [None, {"b": ""}]}, {f"k{i:03}": i for i in range(200)}]
    rows = [(i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate(found)] + [(900, None), (901, ""), (902, "{"), (903, "nope")]
    out = {r.id: r.json for r in pruned_trees(spark, spark.createDataFrame(rows, "id int, raw string"), "id", "raw").collect()}
    assert len(out) == len(rows)
    for i, x in enumerate(found):
        p = plain(x)
        want = p if isinstance(x, dict) else {"value": p if isinstance(x, list) or p not in ("",) else None}
        assert json.loads(out[i]) == want, (x, out[i])
        if isinstance(x, dict):
            assert out[i] == json.dumps(p, ensure_ascii=False, sort_keys=True)
    assert [out[i] for i in (900, 901, 902, 903)] == ["{}"] * 4


def test_no_python_in_the_plan(spark):
    table = spark.range(3).selectExpr("id", "'{\"a\": [1, {}]}' AS raw")
    df = pruned_trees(spark, table, "id", "raw")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and [r.json for r in df.collect()] == ['{"a": [1]}'] * 3
