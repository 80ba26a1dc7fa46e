"""Golden values and identities, and every named query against its SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from relevara.functions import scalars as S
from relevara.operators import agreement, stats
from relevara.operators.judged import DISCOUNTS, built_hits
from relevara.plans import catalogue, evaluation, judging, oracles
from relevara.plans import queries as core
from relevara.sources.readers import flattened, judged_files

QUERIES = core.QUERIES | catalogue.QUERIES | judging.QUERIES | evaluation.QUERIES
ORACLE_SQL = oracles.ORACLE_SQL | catalogue.ORACLE_SQL | judging.ORACLE_SQL | evaluation.ORACLE_SQL
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        at = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at + '/*.parquet' if os.path.isdir(at) else at}')")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


def test_dcg_example():
    gains, pool = [100, 0, 100, 1, 0, 0, 0, 0, 100, 10], [100] * 5 + [10] + [1] * 4
    dcg, best = (sum(g * d for g, d in zip(x, DISCOUNTS)) / 1e14 for x in (gains, pool))
    assert (round(dcg, 6), round(best, 6), round(dcg / best, 6)) == (1.834243, 2.996469, 0.612135)


def test_holm_multiplies_by_what_is_left(spark):
    p = [0.0, 0.0052, 0.0104, 0.02, 0.02, 0.5, 1.0, 0.9]
    out = stats.holm(spark.createDataFrame(list(enumerate(p)), "i int, p_raw double"), [], ["i"]).collect()
    got = {r.i: round(r.p_holm, 4) for r in out}
    assert got == {0: 0.0, 1: 0.0364, 2: 0.0624, 3: 0.1, 4: 0.1, 5: 1.0, 6: 1.0, 7: 1.0}


def test_kappa_of_known_counts(spark):
    pairs = [("Exact", "Exact")] * 20 + [("Exact", "Irrelevant")] * 5 + [("Irrelevant", "Exact")] * 10 + [("Irrelevant", "Irrelevant")] * 15
    r = agreement.kappa(spark.createDataFrame(pairs, "label string, label_b string"), []).first()
    assert (r.n, r.agreement, r.kappa) == (50, 0.7, 0.4)


def test_scalars(spark):
    df = spark.createDataFrame([("$1,299.00",), ("10.00 - 20.00",), ("n/a",), ("",), ("-5",), ("Rs. 500",), ("1.2.3",), (None,)], "x string")
    out = [r.p for r in df.select(S.clean_price(F.col("x")).alias("p")).collect()]
    assert out == [1299.0, 10.0, None, None, 5.0, 500.0, None, None]
    one = spark.range(1).select(
        S.canonical_label(F.lit(" complement ")).alias("a"),
        S.category_pick(F.lit("A > B>>C > ")).alias("b"),
        S.last_segment(F.lit("s:x:y")).alias("c"),
        S.after_first(F.lit("s:x:y")).alias("d"),
        S.url_tail(F.lit("http://h/p/q//")).alias("e"),
        S.clean_text(F.lit(" <NA> ")).alias("f"),
        S.truncated(F.lit(0.729)).alias("g"),
    ).first()
    assert tuple(one) == ("Complementary", "C", "y", "x:y", "q", "", 0.72)


def test_unknown_label_is_an_error(spark):
    with pytest.raises(Exception, match="unknown label"):
        spark.range(1).select(S.gain_code(F.lit("fine"))).collect()


def test_judged_files_round_trip(spark, tmp_path):
    text = '[{"query_id": "q_0001", "category": "auto", "complexity": "simple", "text_query": "x", "providers": {"e1": {"hits": [{"rank": 1, "id": "A-1", "label": "Exact", "score": 1.0}, {"rank": 2, "id": "A1"}]}, "e2": {"hits": []}}}]'
    (tmp_path / "auto.json").write_text(text)
    out = flattened(judged_files(spark, str(tmp_path / "auto.json"))).select("engine", "position", "id").collect()
    assert sorted(map(tuple, out)) == [("e1", 1, "A-1"), ("e1", 2, "A1")]


def test_pushdown_and_pruning(spark):
    plan = built_hits(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_extendedprice" not in plan
