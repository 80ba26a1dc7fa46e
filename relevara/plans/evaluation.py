"""Named queries of judging runs, budgets, families of tests and second paths; each with its SQL where SQL can express it."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relevara.operators import gates as G
from relevara.operators import judge as judging
from relevara.operators import metrics as M
from relevara.operators import resampling, second_path
from relevara.operators import stats as T
from relevara.operators.judged import ENGINES, judged_hit, table
from relevara.operators.judged import queries as query_table
from relevara.operators.running import budgeted
from relevara.plans.oracles import _HIT, _QE
from relevara.sources import archives, landed, sinks
from relevara.streaming import finished

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FOCAL = ENGINES[0]


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@dataclass(frozen=True)
class FixtureJudge:
    """A judge with every kind of failure, by rule: title and description carry the numbers that it goes by.

    Queries 3 mod 10 are busy twice, 4 mod 10 fail with pictures, 5 mod 10 always fail, 6 mod 10 answer without a list once; of
    single products one in 17 is left out of the answer and one in 19 has an unknown label.
    """

    def ask(self, call: judging.Call) -> tuple[str, int]:
        q = int(call.call_id)
        kind = q % 10
        if kind == 3 and call.attempt <= 2:
            raise RuntimeError("429 quota exceeded, try again")
        if kind == 4 and call.with_images:
            raise ValueError("bad picture")
        if kind == 5:
            raise ValueError("no answer")
        if kind == 6 and call.attempt == 1:
            return "sorry", 1
        rows = []
        for i in call.items:
            p = int(i["title"])
            if (q + p) % 17 != 0:
                label = "Fine" if (q + p) % 19 == 0 else ("exact", "Substitute", " complement", "Irrelevant")[(q * 7 + p) % 4]
                rows.append({"index": int(i["item"]), "label": label, "reasoning": f"r{p}"})
        return f"Here: {json.dumps(rows)} done", len(rows)


def fixture_calls(spark: SparkSession, d: str) -> DataFrame:
    """Each query's products over all engines as one call; products of odd number have a picture."""
    hits = judged_hit(spark, d)
    number = F.substring("norm_id", -2, 2).cast("int")
    each = hits.select("query_id", "tier", "norm_id").distinct()
    items = each.select("query_id", F.lit("q").alias("text_query"), "tier", F.col("norm_id").alias("product_id"), number.cast("string").alias("title"), F.lit(None).cast("string").alias("description"), F.lit(1.0).alias("price"), F.lit(None).cast("double").alias("discount_price"), (number % 2 == 1).alias("has_image"))
    return judging.calls_of(items, ["query_id"], [F.col("product_id")])


_ANY_IMAGE = "max(CAST(p % 2 = 1 AS INT)) OVER (PARTITION BY query_id) = 1"


@query(
    _HIT + f""", items AS (SELECT DISTINCT query_id, norm_id, p FROM hit),
lab AS (SELECT *, query_id % 10 AS kind, {_ANY_IMAGE} AS any_image, CASE WHEN (query_id + p) % 17 = 0 OR (query_id + p) % 19 = 0 OR query_id % 10 = 5 THEN NULL ELSE ['Exact','Substitute','Complementary','Irrelevant'][(query_id * 7 + p) % 4 + 1] END AS l FROM items)
SELECT CAST(query_id AS VARCHAR) AS call_id, norm_id AS product_id, coalesce(l, 'Irrelevant') AS label, CASE WHEN l IS NULL THEN 'judge failed after retries' ELSE 'r' || p END AS reasoning, l IS NULL AS failed,
 CAST(CASE kind WHEN 3 THEN 3 WHEN 4 THEN (CASE WHEN any_image THEN 2 ELSE 1 END) WHEN 5 THEN 4 WHEN 6 THEN 2 ELSE 1 END AS INTEGER) AS attempts,
 CASE WHEN kind IN (4, 5, 6) THEN FALSE ELSE any_image END AS with_images, CASE WHEN l IS NULL THEN 'failed' ELSE 'ok' END AS status FROM lab"""
)
def o01_judged(spark: SparkSession, d: str) -> DataFrame:
    """All products judged in rounds by a judge that fails in every way (O1)."""
    rows = judging.judged(spark, fixture_calls(spark, d), FixtureJudge(), sinks.new_path(spark, "judging"))
    return rows.drop("item")


_CALLS = _HIT + """, calls AS (SELECT query_id, CAST(sum(37 + p) AS BIGINT) AS cost, query_id % 11 = 0 AS failed, query_id % 7 = 0 AS cached, (query_id * 7919) % 15485863 AS turn FROM (SELECT DISTINCT query_id, p FROM hit) GROUP BY query_id),
lim AS (SELECT CAST(sum(cost) FILTER (NOT cached) AS BIGINT) * 2 // 5 AS budget FROM calls),
run AS (SELECT *, coalesce(sum(CASE WHEN cached THEN 0 ELSE cost END) OVER w, 0) AS spent, coalesce(sum(CASE WHEN failed AND NOT cached THEN 1 ELSE 0 END) OVER w, 0) AS fails FROM calls, lim WINDOW w AS (ORDER BY turn, query_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(_CALLS + " SELECT query_id, cost, CAST(spent AS BIGINT) AS spent_before, CAST(fails AS BIGINT) AS failed_before, CASE WHEN cached THEN 'cached' WHEN spent > budget OR fails > 1000000 THEN 'aborted' WHEN failed THEN 'failed' ELSE 'ok' END AS status FROM run")
def o03_budget(spark: SparkSession, d: str) -> DataFrame:
    """A stream of calls cut where two fifths of its cost are spent; cached calls cost nothing (O3)."""
    items = judged_hit(spark, d).select("query_id", F.substring("norm_id", -2, 2).cast("int").alias("p")).distinct()
    calls = items.groupBy("query_id").agg(F.sum(F.col("p") + 37).cast("long").alias("cost"))
    calls = sinks.written(spark, calls.withColumns({"failed": F.col("query_id") % 11 == 0, "cached": F.col("query_id") % 7 == 0, "turn": (F.col("query_id") * 7919) % 15485863}))
    budget = (calls.filter("NOT cached").agg(F.sum("cost")).first()[0] or 0) * 2 // 5
    return budgeted(spark, calls, ["turn", "query_id"], budget, 1_000_000).select("query_id", "cost", "spent_before", "failed_before", "status")


def metric_columns() -> dict[str, Column]:
    out = {f"{name}_at_{k}": f(k) for name, f in (("precision", M.precision), ("ndcg", M.ndcg), ("recall", M.recall)) for k in (10, 20)}
    return out | {"effective_zero_rate": M.ezr().cast("double")}


FAMILY = {"precision": ("precision_at_10", "precision_at_20"), "ndcg": ("ndcg_at_10", "ndcg_at_20"), "recall": ("recall_at_10", "recall_at_20"), "ezr": ("effective_zero_rate",)}


def paired_rows(spark: SparkSession, d: str) -> DataFrame:
    """(stream, query_id, diffs, scores): a row for each population and slice that a query is in; seven sectors and three tiers.

    diffs are focal - rival of each metric and rival in 1 / UNIT; scores the engines' values of each metric.
    """
    rows = M.query_engine(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("s"), (F.col("c_nationkey") % 7).cast("string")).alias("seventh")), "query_id")
    metrics = metric_columns()
    per = rows.groupBy("query_id", "seventh", "tier").agg(*[F.max(F.when(F.col("engine") == e, v)).alias(f"{m}_{e}") for m, v in metrics.items() for e in ENGINES])
    long = []
    for population, names in FAMILY.items():
        unit = lambda m, e: F.round((F.col(f"{m}_{FOCAL}") - F.col(f"{m}_{e}")) * resampling.UNIT).cast("long")
        diffs = F.array(*[unit(m, e) for m in names for e in ENGINES[1:]])
        scores = F.array(*[F.round(F.col(f"{m}_{e}") * resampling.UNIT).cast("long") for m in names for e in ENGINES])
        places = [F.lit("pooled"), F.col("seventh"), *([F.col("tier")] if population == "ezr" else [])]
        defined = per.filter(F.col(f"{names[0]}_{FOCAL}").isNotNull())
        long.append(defined.select(F.explode(F.array(*places)).alias("slice"), F.lit(population).alias("population"), "query_id", diffs.alias("diffs"), scores.alias("scores")))
    out = long[0]
    for x in long[1:]:
        out = out.unionByName(x)
    return out.withColumn("stream", F.concat_ws("/", "population", "slice"))


def family_tests(spark: SparkSession, d: str, replicates: int = 10_000) -> DataFrame:
    """One row per test: source, metric, slice, engine, means, observed difference, interval and p from the bootstrap."""
    rows = sinks.written(spark, paired_rows(spark, d), "paired")
    boot = resampling.tested(resampling.resampled(spark, rows.select("stream", "query_id", "diffs"), replicates))
    names = F.create_map(*[F.lit(x) for p, ms in FAMILY.items() for x in (p, json.dumps(ms))])
    metric = lambda i: F.element_at(F.from_json(F.element_at(names, F.col("population")), "array<string>"), i + 1)
    rival = lambda i: F.element_at(F.array(*map(F.lit, ENGINES[1:])), i + 1)
    width = len(ENGINES) - 1
    each = rows.select("stream", "population", "slice", "scores", F.posexplode("diffs").alias("test", "diff"))
    place = lambda e: F.element_at("scores", (F.floor(F.col("test") / width) * len(ENGINES) + 1 + e).cast("int"))
    mean = lambda x: F.round(F.sum(x) / F.count("*") / resampling.UNIT, 9)
    seen = each.groupBy("stream", "population", "slice", "test").agg(mean(place(F.lit(0))).alias("focal_mean"), mean(place(F.col("test") % width + 1)).alias("other_mean"), mean(F.col("diff")).alias("observed_diff"))
    source = F.when(F.col("population") == "ndcg", "corrected_ndcg").when(F.col("population") == "ezr", "ezr").otherwise("original_grid")
    both = seen.join(boot, ["stream", "test"])
    return both.select(source.alias("source"), metric(F.floor(F.col("test") / width).cast("int")).alias("metric"), "slice", rival((F.col("test") % width).cast("int")).alias("engine"), "focal_mean", "other_mean", "observed_diff", F.round("ci_low", 9).alias("ci_low"), F.round("ci_high", 9).alias("ci_high"), F.round("p_raw", 9).alias("p_raw"), F.col("n").alias("n_queries"), F.col("n_replicates").cast("long").alias("n_replicates"))


TIE = ["metric", "engine", "slice"]


def within_noise() -> Column:
    return ~F.col("significant") | ((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0))


@query()
def st1_family_192(spark: SparkSession, d: str) -> DataFrame:
    """Six metrics, four rivals and eight slices, adjusted over all 192 tests (ST1, ST6)."""
    tests = family_tests(spark, d).filter("source <> 'ezr'").drop("source")
    return T.holm(tests, [], TIE).withColumn("within_noise", within_noise()).withColumn("p_holm", F.round("p_holm", 9))


@query()
def st6_family_236(spark: SparkSession, d: str) -> DataFrame:
    """The union of the grid, the pooled nDCG and the EZR tests, adjusted over all 236 (ST6, U2)."""
    return T.holm(family_tests(spark, d), [], ["source", *TIE]).withColumn("p_holm", F.round("p_holm", 9))


@query(
    _QE + """, vals AS (SELECT qe.query_id, 's' || (c_nationkey % 7) AS seventh, tier, engine, unnest([{'m': 'precision_at_10', 'v': p10}, {'m': 'precision_at_20', 'v': p20}, {'m': 'ndcg_at_10', 'v': ndcg10}, {'m': 'ndcg_at_20', 'v': ndcg20}, {'m': 'recall_at_10', 'v': recall10}, {'m': 'recall_at_20', 'v': recall20}, {'m': 'effective_zero_rate', 'v': CAST(ezr AS INT)::DOUBLE}]) AS x FROM qe JOIN customer ON c_custkey = qe.query_id),
flat AS (SELECT query_id, seventh, tier, engine, x.m AS metric, x.v AS v FROM vals WHERE x.v IS NOT NULL),
pair AS (SELECT r.metric, r.engine, s.slice, f.v AS fv, r.v AS rv FROM flat r JOIN flat f ON f.query_id = r.query_id AND f.metric = r.metric AND f.engine = 'focal' AND r.engine <> 'focal', LATERAL (SELECT unnest(CASE WHEN r.metric = 'effective_zero_rate' THEN ['pooled', r.seventh, r.tier] ELSE ['pooled', r.seventh] END) AS slice) s)
SELECT metric, slice, engine, count(*) AS n_queries, round(avg(fv), 6) AS focal_mean, round(avg(rv), 6) AS other_mean, round(avg(fv - rv), 6) AS observed_diff FROM pair GROUP BY ALL"""
)
def st6_observed(spark: SparkSession, d: str) -> DataFrame:
    """Means and differences of all tests of the consolidated family, without the resampling."""
    rows, width, each = paired_rows(spark, d), len(ENGINES) - 1, None
    mean = lambda x: F.round(F.sum(x) / F.count("*") / resampling.UNIT, 6)
    for population, names in FAMILY.items():
        tests = []
        for i, m in enumerate(names):
            first = i * len(ENGINES) + 1
            for j, e in enumerate(ENGINES[1:]):
                tests.append(F.struct(F.lit(m).alias("metric"), F.lit(e).alias("engine"), F.element_at("scores", first).alias("f"), F.element_at("scores", first + j + 1).alias("r"), F.element_at("diffs", i * width + j + 1).alias("d")))
        part = rows.filter(F.col("population") == population).select("slice", F.explode(F.array(*tests)).alias("x")).select("slice", "x.*")
        each = part if each is None else each.unionByName(part)
    return each.groupBy("metric", "slice", "engine").agg(F.count("*").alias("n_queries"), mean(F.col("f")).alias("focal_mean"), mean(F.col("r")).alias("other_mean"), mean(F.col("d")).alias("observed_diff"))


_CELLS = _QE + """, long AS (SELECT engine, sector, tier, unnest([{'m': 'ezr', 'v': CAST(ezr AS INT)::DOUBLE}, {'m': 'ndcg10', 'v': ndcg10}, {'m': 'ndcg20', 'v': ndcg20}, {'m': 'recall10', 'v': recall10}, {'m': 'recall20', 'v': recall20}, {'m': 'p10', 'v': p10}, {'m': 'p20', 'v': p20}]) AS x FROM qe),
cell AS (SELECT s.slice, engine, x.m AS metric, count(*) AS n, avg(x.v) AS value FROM long, LATERAL (SELECT unnest(['overall', sector, tier]) AS slice) s WHERE x.v IS NOT NULL GROUP BY ALL)"""


def first_path(spark: SparkSession, d: str) -> DataFrame:
    """(slice, engine, metric, n, value) of the metric plans."""
    values = {"ezr": M.ezr().cast("double"), **{f"{m}{k}": f(k) for m, f in (("ndcg", M.ndcg), ("recall", M.recall), ("p", M.precision)) for k in (10, 20)}}
    wide = M.cells(M.query_engine(spark, d), *[F.avg(v).alias(m) for m, v in values.items()], *[F.count(v).alias(f"n_{m}") for m, v in values.items()])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"n_{m}").alias("k"), F.col(m).alias("value")) for m in values]))
    return wide.select("slice", "engine", each.alias("x")).select("slice", "engine", "x.metric", F.col("x.k").alias("n"), "x.value").filter("n > 0")


def equality(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(slice, engine, metric, got, want, passes): both paths' cells, equal in population and, within ``tolerance``, in value."""
    keys = ["slice", "engine", "metric"]
    gate = G.compared(a.select(*keys, "value"), b.select(*keys, "value"), keys, tolerance)
    n = a.select(*keys, F.col("n").alias("n_a")).join(b.select(*keys, F.col("n").alias("n_b")), keys, "full")
    return gate.join(n, keys).withColumn("passes", F.col("passes") & F.col("n_a").eqNullSafe(F.col("n_b"))).drop("n_a", "n_b")


@query(_CELLS + " SELECT slice, engine, metric, round(value, 9) AS got, round(value, 9) AS want, TRUE AS passes FROM cell")
def g04_two_paths(spark: SparkSession, d: str) -> DataFrame:
    """All cells by the metric plans and by lists with exact decimals, equal at 1e-9."""
    second = second_path.cells(judged_hit(spark, d), ENGINES, query_table(spark, d))
    gate = equality(first_path(spark, d), second)
    return gate.select("slice", "engine", "metric", F.round("got", 9).alias("got"), F.round("want", 9).alias("want"), "passes")


_RICH = ("ndcg10", "ndcg20", "recall10", "recall20", "junk10", "junk20", "alljunk", "nrel")


def rich_metrics(rows: DataFrame) -> DataFrame:
    """One row per engine: every metric as struct<rate, n>, and by_tier, a map from tier to the same structs: one grouped plan.

    A rate is a mean over the n queries for which the metric is defined; all-junk counts every query, junk those with hits.
    """
    values = {f"{m}{k}": f(k) for m, f in (("ndcg", M.ndcg), ("recall", M.recall), ("junk", M.junk)) for k in (10, 20)}
    values |= {"alljunk": M.all_junk().cast("double"), "nrel": F.col("nrel").cast("double")}
    cells = F.struct(*[F.struct(F.avg(values[m]).alias("rate"), F.count(values[m]).alias("n")).alias(m) for m in _RICH])
    both = rows.groupingSets([["engine"], ["engine", "tier"]], "engine", "tier").agg(F.grouping_id("engine", "tier").alias("g"), cells.alias("c"))
    return both.groupBy("engine").agg(F.max(F.when(F.col("g") == 1, F.col("c"))).alias("all"), F.map_from_entries(F.collect_list(F.when(F.col("g") == 0, F.struct("tier", "c")))).alias("by_tier")).select("engine", "all.*", "by_tier")


@query(
    _QE + f""", long AS (SELECT engine, tier, unnest([{", ".join("{'m': '" + m + "', 'v': " + {'alljunk': 'CAST(coalesce(junk_only, FALSE) AS INT)::DOUBLE', 'nrel': 'nrel::DOUBLE'}.get(m, m) + "}" for m in _RICH)}]) AS x FROM qe)
SELECT engine, s.t AS tier, x.m AS metric, count(x.v) AS n, round(avg(x.v), 9) AS rate FROM long, LATERAL (SELECT unnest(['all', long.tier]) AS t) s GROUP BY ALL"""
)
def a13_all_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The whole of the rich metrics, {rate, n} overall and by tier, as rows."""
    per = rich_metrics(M.query_engine(spark, d))
    whole = F.map_from_entries(F.array(F.struct(F.lit("all"), F.struct(*_RICH))))
    tiers = per.select("engine", F.explode(F.map_concat(whole, "by_tier")).alias("tier", "c"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"c.{m}.n").alias("n"), F.col(f"c.{m}.rate").alias("rate")) for m in _RICH]))
    return tiers.select("engine", "tier", each.alias("x")).select("engine", "tier", "x.metric", "x.n", F.round("x.rate", 9).alias("rate"))


@query(_HIT + "SELECT query_id, engine, rank, raw_id, CASE WHEN query_id % 3 = 0 THEN 'second' ELSE 'first' END AS run FROM hit WHERE query_id % 3 <> 0 OR rank <= 5")
def k07_stream(spark: SparkSession, d: str) -> DataFrame:
    """Finished queries as a stream: a second run replaces every third query, with shorter lists (K7)."""
    hits = judged_hit(spark, d).select("query_id", "engine", "rank", "raw_id")
    landed, store = sinks.new_path(spark, "landed"), sinks.new_path(spark, "finished")
    rows = hits.withColumn("run", F.lit("first"))
    again = hits.filter((F.col("query_id") % 3 == 0) & (F.col("rank") <= 5)).withColumn("run", F.lit("second"))
    for wave, part in (("a", rows), ("b", again)):
        part.coalesce(4).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(rows.schema).parquet(landed)
        finished.keep_finished(stream, store, f"{store}-checkpoint").awaitTermination()
        if wave == "b":
            finished.compacted(spark, store, "query_id", rows.schema)
    return finished.current(spark, store, "query_id", rows.schema)


SHAPE_OF = dict(zip(ENGINES, ("nested_documents", "flat_objects", "text_columns", "attribute_lists", "parallel_arrays"), strict=True))


def landed_lines(hits: DataFrame, engine: str) -> DataFrame:
    """(engine, value): a line for each query with the payload that the engine's shape has."""
    c, text = F.col, lambda x: x.cast("string")
    brand, price, now = F.concat(F.lit("b"), text(c("p"))), c("p") * 1.5, c("p").cast("double")
    name = F.concat(F.lit("t"), c("norm_id"))
    product = {
        "focal": F.struct(c("raw_id").alias("id"), F.lit(2.5).alias("score"), F.struct(name.alias("title"), F.struct(brand.alias("brand")).alias("metadata"), F.array(F.concat(F.lit("i"), text(c("p"))), F.lit("other")).alias("images"), price.alias("original_price"), now.alias("discounted_price")).alias("metadata")),
        "rival_a": F.struct(c("raw_id").alias("id"), name.alias("title"), F.struct(brand.alias("brandName")).alias("metadata"), F.array(F.concat(F.lit("i"), text(c("p")))).alias("images"), price.alias("original_price"), now.alias("discounted_price")),
        "rival_b": F.struct(c("raw_id").alias("id"), name.alias("title"), brand.alias("brand"), F.to_json(F.array(F.concat(F.lit("i"), text(c("p"))))).alias("images"), text(price).alias("price"), text(now).alias("sale_price")),
        "rival_c": F.struct(c("raw_id").alias("url"), F.struct(name.alias("title"), F.array(brand).alias("brand"), F.concat(F.lit("i"), text(c("p"))).alias("image_link"), price.alias("price_old"), now.alias("price")).alias("attributes")),
        "rival_d": F.struct(c("raw_id").alias("id"), name.alias("name"), brand.alias("brand"), F.concat(F.lit("i"), text(c("p"))).alias("image"), price.alias("list_price"), now.alias("price")),
    }[engine]
    own = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.when(c("rank").isNotNull(), F.struct("rank", product.alias("x"))))), lambda r: r["x"]).alias("x"))
    payload = {
        "focal": F.struct(c("x").alias("documents"), F.size("x").alias("num_total_results")),
        "rival_a": F.struct(c("x").alias("hits"), F.size("x").alias("nb_hits")),
        "rival_b": F.struct(c("x").alias("results"), F.size("x").alias("total")),
        "rival_c": F.struct(F.struct(c("x").alias("hits"), F.size("x").alias("total_hits")).alias("results")),
        "rival_d": F.struct(c("x").alias("product_data"), F.size("x").alias("count")),
    }[engine]
    return own.select(F.lit(engine).alias("engine"), F.to_json(F.struct(text(c("query_id")).alias("query_id"), F.lit(12.5).alias("latency_ms"), payload.alias("payload"))).alias("value"))


@query(
    _HIT + """, full_ AS (SELECT g.query_id, g.engine, h.rank, h.raw_id, h.norm_id, h.p FROM grid g LEFT JOIN hit h ON h.query_id = g.query_id AND h.engine = g.engine WHERE g.engine <> 'rival_a')
SELECT CAST(query_id AS VARCHAR) AS query_id, engine, coalesce(rank, 0) AS rank, raw_id AS id, coalesce('t' || norm_id, '') AS title, coalesce('b' || p, '') AS subtitle, coalesce('i' || p, '') AS image, p * 1.5::DOUBLE AS price, p::DOUBLE AS discount_price, 12.5::DOUBLE AS latency_ms, CAST(count(rank) OVER (PARTITION BY query_id, engine) AS BIGINT) AS total FROM full_"""
)
def s14_landed_search(spark: SparkSession, d: str) -> DataFrame:
    """Landed payloads of five shapes as one table of hits; one engine left out, some columns made."""
    number = F.substring("norm_id", -2, 2).cast("int").alias("p")
    hits = judged_hit(spark, d).select("query_id", "engine", "rank", "raw_id", "norm_id", number)
    every = query_table(spark, d).select("query_id")
    path = sinks.new_path(spark, "landed-search")
    for e in ENGINES:
        landed_lines(every.join(hits.filter(F.col("engine") == e).drop("engine"), "query_id", "left"), e).write.mode("append").partitionBy("engine").text(path)
    landed.register(spark)
    wanted = "query_id string, engine string, rank int, id string, title string, subtitle string, image string, price double, discount_price double, latency_ms double, total long"
    rows = spark.read.format("landed_search").schema(wanted).option("shapes", json.dumps(SHAPE_OF)).load(path)
    return rows.filter(F.col("engine").isin(*[e for e in ENGINES if e != "rival_a"]))


@query("SELECT source AS archive, 'docs/' || doc_id || '.txt' AS member, CAST(2 * count(*) OVER (PARTITION BY source) AS INTEGER) AS n_members, length(text) - length(replace(text, chr(10), '')) AS n_breaks FROM (SELECT * FROM (SELECT DISTINCT ON (doc_id) coalesce(source, 'none') AS source, doc_id, coalesce(text, '') AS text FROM documents)) QUALIFY doc_id % 10 = 3 AND length(text) > 0")
def s12_archive_members(spark: SparkSession, d: str) -> DataFrame:
    """Of an archive for each source, every document and its note, only the documents whose names are wanted."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    member = lambda kind, text: docs.select("source", F.concat(F.lit(f"{kind}/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), text.alias("text"))
    zips = archives.packed(member("docs", F.col("text")).unionByName(member("notes", F.lit("a note"))), "source", "name", "text")
    lines = archives.members(sinks.written(spark, zips, "archives"), ["docs/*3.txt"])
    whole = docs.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("member"), F.endswith("text", F.lit("\n")).cast("int").alias("more"))
    per = lines.groupBy(F.col("path").alias("archive"), "member", "n_members").agg((F.count("*") - 1).alias("n"))
    return per.join(whole, "member").select("archive", "member", "n_members", (F.col("n") + F.col("more")).alias("n_breaks"))


# the fixture's judge goes to the executors by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])
