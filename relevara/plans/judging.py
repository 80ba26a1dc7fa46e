"""Named queries around judgments, statistics, gates and files; each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevara.functions import responses as R
from relevara.functions import scalars as S
from relevara.operators import agreement as A
from relevara.operators import gates as G
from relevara.operators import judging as J
from relevara.operators import metrics as M
from relevara.operators import stats as T
from relevara.operators.inverted_index import search
from relevara.operators.judged import ENGINES, judged_hit, pool, table
from relevara.operators.judged import queries as query_table
from relevara.plans import queries as P
from relevara.plans.oracles import _AGG, _BM, _BOOT, _COLL, _HIT, _QE, _TITLED, _TOK, _metrics
from relevara.sources import readers, sinks

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


_LAB = _HIT.replace("WITH RECURSIVE", "WITH RECURSIVE", 1)


@query(
    _LAB + """, k AS (SELECT *, (query_id + rank) % 5 AS m FROM labelled) SELECT query_id, engine, rank, CASE WHEN query_id % 3 = 0 AND m = 4 THEN 'fresh' WHEN query_id % 3 = 0 THEN 'cache' WHEN query_id % 3 = 1 THEN 'fresh' ELSE 'failed' END AS source,
 CASE WHEN query_id % 3 = 2 THEN 'Irrelevant' ELSE label END AS label FROM (SELECT *, max(m = 4) OVER (PARTITION BY query_id, raw_id) AS lost FROM k) WHERE NOT (query_id % 3 = 0 AND lost <> (m = 4))"""
)
def j01_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """Labels from the cache, else from new judgments, else failed; cached failures are not used (F8)."""
    hits = judged_hit(spark, d)
    m = (F.col("query_id") + F.col("rank")) % 5 == 4
    lost = F.max(m).over(Window.partitionBy("query_id", "raw_id"))
    hits = hits.withColumn("m", m).withColumn("lost", lost).filter(~((F.col("query_id") % 3 == 0) & (F.col("lost") != F.col("m"))))
    stored = hits.filter(F.col("query_id") % 3 == 0).withColumn("reasoning", F.when(F.col("m"), J.FAILED).otherwise("fine"))
    cache = J.reusable(stored).select("query_id", "raw_id", "label").distinct()
    fresh = hits.filter((F.col("query_id") % 3 == 1) | F.col("m")).filter(F.col("query_id") % 3 != 2).select("query_id", "raw_id", "label").distinct()
    return J.judged_with_fallback(hits.drop("gain_code"), cache, fresh).select("query_id", "engine", "rank", "source", "label")


@query(_QE + "SELECT h.query_id, h.engine, count(*) AS n_found FROM hit h JOIN (SELECT DISTINCT query_id, norm_id FROM hit WHERE gain_code = 100 AND engine <> 'focal') p USING (query_id, norm_id) GROUP BY ALL")
def j02_in_pool(spark: SparkSession, d: str) -> DataFrame:
    """Hits of each engine among the exact products that other engines than the focal one found."""
    hits = judged_hit(spark, d)
    own = hits.filter((F.col("gain_code") == 100) & (F.col("engine") != FOCAL)).select("query_id", "norm_id").distinct()
    return hits.join(own, ["query_id", "norm_id"], "left_semi").groupBy("query_id", "engine").agg(F.count("*").alias("n_found"))


_THREE = _HIT + """, c3 AS (SELECT *, CASE WHEN (query_id * 13 + p * 7) % 100 < 15 THEN (CASE label WHEN 'Exact' THEN 'Substitute' WHEN 'Substitute' THEN 'Complementary' WHEN 'Complementary' THEN 'Irrelevant' ELSE 'Exact' END) ELSE label END AS label_c FROM two)"""


def third_set(hits: DataFrame) -> DataFrame:
    return A.relabelled(hits, 13, 7, 15).select("query_id", "engine", "rank", F.col("label_b").alias("label_c"))


@query(_THREE + "SELECT sector, count(*) AS n, count(*) FILTER (label = label_b AND label = label_c) AS n_all, count(*) FILTER (label_b = label_c) AS n_bc FROM c3 WHERE query_id % 4 <> 0 AND query_id % 5 <> 0 GROUP BY sector")
def j06_three_label_sets(spark: SparkSession, d: str) -> DataFrame:
    """Only hits that all three sets have."""
    keys = ["query_id", "engine", "rank"]
    hits = judged_hit(spark, d)
    b = A.relabelled(hits, 31, 17, 12).filter(F.col("query_id") % 4 != 0).select(*keys, "label_b")
    c = third_set(hits).filter(F.col("query_id") % 5 != 0)
    both = hits.join(b, keys).join(c, keys)
    same = F.col("label") == F.col("label_b")
    return both.groupBy("sector").agg(F.count("*").alias("n"), F.count_if(same & (F.col("label") == F.col("label_c"))).alias("n_all"), F.count_if(F.col("label_b") == F.col("label_c")).alias("n_bc"))


@query(_HIT + "SELECT query_id, engine, rank, query_id % 4 <> 0 AND rank % 6 <> 0 AS from_other, CASE WHEN query_id % 4 <> 0 AND rank % 6 <> 0 THEN label_b ELSE label END AS label FROM two")
def j07_label_source(spark: SparkSession, d: str) -> DataFrame:
    keys = ["query_id", "engine", "rank"]
    hits = judged_hit(spark, d)
    other = A.relabelled(hits, 31, 17, 12).filter(F.col("query_id") % 4 != 0).select(*keys, F.when(F.col("rank") % 6 == 0, "??").otherwise(F.col("label_b")).alias("label"))
    return J.label_or(hits, other, keys).select(*keys, "from_other", "label")


@query(_QE + "SELECT query_id, engine, CASE WHEN query_id % 9 = 0 THEN false ELSE n_hits = 0 END AS zero_result FROM qe")
def j16_zero_flag(spark: SparkSession, d: str) -> DataFrame:
    """The raw run's zero flag of each judged query and engine, false where the raw run hasn't it."""
    rows = M.query_engine(spark, d).select("query_id", "engine", "n_hits")
    raw = rows.filter(F.col("query_id") % 9 != 0).select("query_id", "engine", (F.col("n_hits") == 0).alias("zero"))
    return rows.join(raw, ["query_id", "engine"], "left").select("query_id", "engine", F.coalesce("zero", F.lit(False)).alias("zero_result"))


@query(_HIT + "SELECT query_id FROM qs WHERE query_id % 7 <> 0 AND (query_id % 4 = 1 OR query_id % 5 = 2)")
def f09_needs_run(spark: SparkSession, d: str) -> DataFrame:
    """Queries with a text (F3) that lack an engine or have one with an error."""
    asked = query_table(spark, d).select("query_id", F.when(F.col("query_id") % 7 != 0, F.concat(F.lit("q"), F.col("query_id").cast("string"))).otherwise("").alias("text_query"))
    done = query_table(spark, d).withColumn("engine", F.explode(F.array(*map(F.lit, ENGINES)))).filter(~((F.col("query_id") % 4 == 1) & (F.col("engine") == "rival_b"))).withColumn("error", F.when((F.col("query_id") % 5 == 2) & (F.col("engine") == FOCAL), "timeout"))
    return J.needs_run(asked, done, ENGINES).select("query_id")


def latencies(spark: SparkSession, d: str) -> DataFrame:
    """A run per query and engine: some without a latency, some with an error."""
    k = F.col("query_id") * 37 + F.length("engine") * 11
    rows = query_table(spark, d).withColumn("engine", F.explode(F.array(*map(F.lit, ENGINES))))
    return rows.select("query_id", "sector", "engine", F.when(k % 10 != 0, (k % 900).cast("double")).alias("latency_ms"), F.when(k % 10 == 0, "timeout").alias("error"))


@query(_HIT + ", l AS (SELECT engine, query_id * 37 + length(engine) * 11 AS k FROM grid) SELECT engine, count(*) FILTER (k % 10 <> 0) AS n_ok, count(*) FILTER (k % 10 = 0) AS n_errors, round(avg(k % 900) FILTER (k % 10 <> 0), 1) AS mean_ms FROM l GROUP BY engine")
def a33_latency(spark: SparkSession, d: str) -> DataFrame:
    return latencies(spark, d).groupBy("engine").agg(F.count("latency_ms").alias("n_ok"), F.count("error").alias("n_errors"), F.round(F.avg("latency_ms"), 1).alias("mean_ms"))


@query(_HIT + "SELECT coalesce(sector, 'all') AS sector, count(*) AS n, count(*) FILTER (p % 7 <> 0) AS resolved, round(100 * count(*) FILTER (p % 7 <> 0) / count(*), 1) AS pct FROM hit GROUP BY ROLLUP (sector)")
def a34_image_table(spark: SparkSession, d: str) -> DataFrame:
    """Pictures resolved by sector, with the total."""
    found = F.substring("norm_id", -2, 2).cast("int") % 7 != 0
    rows = judged_hit(spark, d).rollup("sector").agg(F.count("*").alias("n"), F.count_if(found).alias("resolved"))
    return rows.select(F.coalesce("sector", F.lit("all")).alias("sector"), "n", "resolved", F.round(100 * F.col("resolved") / F.col("n"), 1).alias("pct"))


@query(_QE + "SELECT engine, sector, count(*) AS n, round(avg(ndcg10), 9) AS ndcg10, round(avg(p10), 9) AS p10, round(avg(recall10), 9) AS recall10, round(avg(CAST(ezr AS INT)), 9) AS ezr, round(avg(CAST(zero AS INT)), 9) AS zero_rate, round(1 - avg(CAST(zero AS INT)), 9) AS coverage FROM qe GROUP BY ALL")
def a35_sector_grid(spark: SparkSession, d: str) -> DataFrame:
    m = [("ndcg10", M.ndcg(10)), ("p10", M.precision(10)), ("recall10", M.recall(10)), ("ezr", M.ezr()), ("zero_rate", M.zero())]
    return M.query_engine(spark, d).groupBy("engine", "sector").agg(F.count("*").alias("n"), *[M.mean(x).alias(n) for n, x in m], F.round(1 - F.avg(M.zero()), 9).alias("coverage"))


@query(_COLL + "SELECT least(label_a, label_b) AS one, greatest(label_a, label_b) AS other, count(*) AS n FROM pairs WHERE label_a <> label_b GROUP BY ALL")
def a36_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return P.collisions(spark, d).filter("label_a <> label_b").groupBy(F.least("label_a", "label_b").alias("one"), F.greatest("label_a", "label_b").alias("other")).agg(F.count("*").alias("n"))


@query(
    _HIT + """, r AS (SELECT query_id, norm_id, raw_id, engine, CASE WHEN engine = 'focal' THEN gain_b ELSE gain_code END AS g, (query_id * 7919 + length(engine) * 104729 + ascii(right(engine, 1)) * 1299709 + 42) % 15485863 AS o FROM both2)
SELECT query_id, norm_id, arg_min(g, (o, raw_id, engine)) AS gain FROM r GROUP BY ALL"""
)
def a37_seeded_choice(spark: SparkSession, d: str) -> DataFrame:
    """One judgment of each product, chosen by a seed."""
    hits = P.two_sets(spark, d).withColumn("g", F.when(F.col("engine") == FOCAL, A.gain_of(F.col("label_b"))).otherwise(F.col("gain_code")))
    o = (F.col("query_id") * 7919 + F.length("engine") * 104729 + F.ascii(F.right("engine", F.lit(1))) * 1299709 + 42) % 15485863
    return hits.groupBy("query_id", "norm_id").agg(F.min_by("g", F.struct(o, "raw_id", "engine")).alias("gain"))


@query(
    _HIT + """, u AS (SELECT query_id, engine, sum(rank * 100) AS tin, sum(rank * 10) AS tout, query_id % 4 AS s FROM hit GROUP BY ALL)
SELECT engine, count(*) AS calls, count(*) FILTER (s = 0) AS n_ok, count(*) FILTER (s = 1) AS cached, count(*) FILTER (s = 2) AS failed, CAST(sum(s) AS BIGINT) AS retries, CAST(sum(tin) AS BIGINT) AS tokens_in, CAST(sum(tout) AS BIGINT) AS tokens_out, round((sum(tin) * 3.0::DOUBLE + sum(tout) * 15.0::DOUBLE) / 1e6::DOUBLE, 6) AS spend FROM u GROUP BY engine"""
)
def a41_operations(spark: SparkSession, d: str) -> DataFrame:
    """Statuses, retries, tokens and spend (P43) of a run."""
    u = judged_hit(spark, d).groupBy("query_id", "engine").agg(F.sum(F.col("rank") * 100).alias("tin"), F.sum(F.col("rank") * 10).alias("tout"))
    s = F.col("query_id") % 4
    out = u.groupBy("engine").agg(F.count("*").alias("calls"), *[F.count_if(s == i).alias(n) for i, n in enumerate(("n_ok", "cached", "failed"))], F.sum(s).alias("retries"), F.sum("tin").alias("tokens_in"), F.sum("tout").alias("tokens_out"))
    return out.withColumn("spend", F.round(R.cost(F.col("tokens_in"), F.col("tokens_out"), 3.0, 15.0), 6))


@query(
    _HIT + _metrics("both2", "gain_code") + _metrics("both2", "gain_b", "_b") + """, s AS (SELECT a.sector, a.engine, round(avg(a.ndcg10), 9) AS x, round(avg(b.ndcg10), 9) AS y FROM qe a JOIN qe_b b ON a.query_id = b.query_id AND a.engine = b.engine GROUP BY ALL),
o AS (SELECT sector, string_agg(engine, ' > ' ORDER BY x DESC, engine) AS before, string_agg(engine, ' > ' ORDER BY y DESC, engine) AS after FROM s GROUP BY sector) SELECT *, before <> after AS changed FROM o"""
)
def w08_order_changes(spark: SparkSession, d: str) -> DataFrame:
    """Engines from best to worst under two definitions, and whether the order changes."""
    hits = P.two_sets(spark, d)

    def ordering(name: str, code: Column) -> DataFrame:
        per = M.query_engine(spark, d, hits.withColumn("gain_code", code)).groupBy("sector", "engine").agg(M.mean(M.ndcg(10)).alias("s"))
        ordered = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("k"), "engine")))
        return per.groupBy("sector").agg(F.array_join(F.transform(ordered, lambda e: e["engine"]), " > ").alias(name))

    return ordering("before", F.col("gain_code")).join(ordering("after", A.gain_of(F.col("label_b"))), "sector").withColumn("changed", F.col("before") != F.col("after"))


@query(
    """WITH RECURSIVE i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r, CAST(l_partkey % 3 <> 0 AS INT) AS has_image, CAST(l_suppkey % 40 AS BIGINT) AS bytes FROM lineitem),
w AS (SELECT l_orderkey, r, 0 AS chunk, has_image AS im, bytes AS b FROM i WHERE r = 1 UNION ALL
 SELECT i.l_orderkey, i.r, w.chunk + CASE WHEN w.im + i.has_image > 2 OR w.b + i.bytes > 50 THEN 1 ELSE 0 END, CASE WHEN w.im + i.has_image > 2 OR w.b + i.bytes > 50 THEN i.has_image ELSE w.im + i.has_image END, CASE WHEN w.im + i.has_image > 2 OR w.b + i.bytes > 50 THEN i.bytes ELSE w.b + i.bytes END
 FROM w JOIN i ON i.l_orderkey = w.l_orderkey AND i.r = w.r + 1)
SELECT l_orderkey, max(chunk) + 1 AS n_chunks, CAST(sum(chunk * r) AS BIGINT) AS mark FROM w GROUP BY ALL"""
)
def w10_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Items of an order in calls of at most two pictures and 50 bytes."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 3 != 0).cast("int").alias("has_image"), (F.col("l_suppkey") % 40).alias("bytes"))
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    out = J.chunked(items, "l_orderkey", order, 2, 50)
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    return out.withColumn("r", place).groupBy("l_orderkey").agg((F.max("chunk") + 1).alias("n_chunks"), F.sum(F.col("chunk") * F.col("r")).alias("mark"))


@query()
def w11_pilot(spark: SparkSession, d: str) -> DataFrame:
    """Nine queries of a pilot; tested against a plain version."""
    rows = M.query_engine(spark, d).groupBy("query_id", "sector", "tier").agg(F.sum("n_hits").alias("n_items"), F.sum("nrel").alias("n_images"))
    rows = sinks.written(spark, rows, "pilot")  # every pick reads it
    picks = J.pilot(rows, "BUILDING")
    return spark.createDataFrame([(i, p["query_id"], p["sector"], p["tier"]) for i, p in enumerate(picks)], "pick int, query_id long, sector string, tier string")


_SIGNED = _BOOT + ", means AS (SELECT engine, slice, round(sum(diff) / count(*), 9) AS diff FROM diffs GROUP BY ALL), all_ AS (SELECT h.*, m.diff, p_holm < 0.05 AS significant, NOT p_holm < 0.05 OR (ci_low <= 0 AND ci_high >= 0) AS within_noise FROM holm h JOIN means m USING (engine, slice))"


def ezr_rows(spark: SparkSession, d: str) -> DataFrame:
    """All EZR tests with means, intervals, Holm and noise."""
    diffs, tests = P.ezr_tests(spark, d)
    mean = diffs.groupBy("engine", "slice").agg(F.round(F.sum("diff") / F.count("*"), 9).alias("diff"))
    out = T.holm(tests, [], ["engine", "slice"]).join(mean, ["engine", "slice"])
    return out.withColumn("within_noise", ~F.col("significant") | ((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)))


@query(_SIGNED + "SELECT engine, slice, diff FROM all_ WHERE significant ORDER BY diff, engine, slice LIMIT 10")
def t03_smallest_signed(spark: SparkSession, d: str) -> DataFrame:
    return ezr_rows(spark, d).filter("significant").orderBy("diff", "engine", "slice").limit(10).select("engine", "slice", "diff")


@query(_SIGNED + "SELECT engine, slice, diff FROM all_ WHERE NOT within_noise ORDER BY abs(diff), engine, slice LIMIT 8")
def t04_narrow_without_noise(spark: SparkSession, d: str) -> DataFrame:
    return ezr_rows(spark, d).filter("NOT within_noise").orderBy(F.abs("diff"), "engine", "slice").limit(8).select("engine", "slice", "diff")


@query(_SIGNED + "SELECT engine, slice, round((0 - diff) * 100, 6) AS adv, round((0 - ci_high) * 100, 6) AS lo, round((0 - ci_low) * 100, 6) AS hi, -ci_high > 0 AS clear_of_zero FROM all_ WHERE slice = 'overall'")
def a30_forest(spark: SparkSession, d: str) -> DataFrame:
    """Advantages over each rival, turned round as lower is better."""
    out = T.forest(ezr_rows(spark, d).filter("slice = 'overall'").withColumn("metric", F.lit("ezr")), {"ezr": True})
    return out.select("engine", "slice", *[F.round(c, 6).alias(c) for c in ("adv", "lo", "hi")], "clear_of_zero")


_STABLE = _HIT + """, per AS (SELECT sector, engine, sum(gain_code) / count(*) AS x, sum(gain_b) / count(*) AS y FROM both2 GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY sector ORDER BY x) + (count(*) OVER (PARTITION BY sector, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY sector ORDER BY y) + (count(*) OVER (PARTITION BY sector, y) - 1) / 2 AS ry FROM per),
rho AS (SELECT sector, round(corr(rx, ry), 9) AS rho FROM rk GROUP BY sector)"""


@query(_STABLE + " SELECT a.sector AS delta_sector, a.engine AS delta_engine, a.delta, b.sector AS rho_sector, b.rho FROM (SELECT sector, engine, round(y - x, 9) AS delta FROM per ORDER BY abs(round(y - x, 9)) DESC, sector, engine LIMIT 1) a, (SELECT * FROM rho ORDER BY rho, sector LIMIT 1) b")
def t05_extremes(spark: SparkSession, d: str) -> DataFrame:
    """The cell that moves most and the sector with the lowest rank correlation."""
    per = P.two_sets(spark, d).groupBy("sector", "engine").agg((F.sum("gain_code") / F.count("*")).alias("x"), (F.sum(A.gain_of(F.col("label_b"))) / F.count("*")).alias("y"))
    delta = per.withColumn("delta", F.round(F.col("y") - F.col("x"), 9))
    big = delta.agg(F.min_by(F.struct("sector", "engine", "delta"), F.struct(-F.abs("delta"), "sector", "engine")).alias("b"))
    low = P.w07_spearman(spark, d).agg(F.min_by(F.struct("sector", "rho"), F.struct("rho", "sector")).alias("r"))
    return big.join(F.broadcast(low), F.lit(True)).select(F.col("b.sector").alias("delta_sector"), F.col("b.engine").alias("delta_engine"), "b.delta", F.col("r.sector").alias("rho_sector"), "r.rho")


@query(_STABLE + " SELECT min(rho) AS least_rho, (SELECT max(abs(round(y - x, 9))) FROM per) AS largest, min(rho) >= 0.9 AND (SELECT max(abs(round(y - x, 9))) FROM per) < 5 AS stable FROM rho")
def st9_verdict(spark: SparkSession, d: str) -> DataFrame:
    x = t05_extremes(spark, d)
    return x.select(F.col("rho").alias("least_rho"), F.abs("delta").alias("largest"), T.stable(F.col("rho"), F.col("delta")).alias("stable"))


@query(_QE + "SELECT query_id, sector, tier FROM qs WHERE query_id IN (SELECT min(query_id) FROM qe WHERE engine = 'focal' AND ezr GROUP BY sector)")
def t06_first_examples(spark: SparkSession, d: str) -> DataFrame:
    """The first query of each sector without a useful result of the focal engine."""
    rows = M.query_engine(spark, d).filter((F.col("engine") == FOCAL) & (M.ezr() == 1))
    return rows.groupBy("sector").agg(F.min_by(F.struct("query_id", "tier"), "query_id").alias("m")).select("m.query_id", "sector", "m.tier")


@query(_HIT + "SELECT query_id, sector, tier FROM qs ORDER BY query_id LIMIT 25")
def t07_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 queries: what a limit on the command line runs."""
    return query_table(spark, d).orderBy("query_id").limit(25)


_FAMILY = _QE + """, vals AS (SELECT engine, query_id, sector, tier, 'ezr' AS metric, CAST(ezr AS INT)::DOUBLE AS v FROM qe UNION ALL SELECT engine, query_id, sector, tier, 'p10', p10 FROM qe),
dd AS (SELECT r.metric, r.engine, s.slice, f.v - r.v AS diff FROM vals r JOIN vals f ON f.query_id = r.query_id AND f.metric = r.metric AND f.engine = 'focal' AND r.engine <> 'focal', LATERAL (SELECT unnest(['overall', r.sector]) AS slice) s),
t AS (SELECT metric, engine, slice, count(*) FILTER (diff > 0) AS up, count(*) FILTER (diff < 0) AS down FROM dd GROUP BY ALL),
p AS (SELECT *, least(1.0::DOUBLE, round(exp(-2.0::DOUBLE * (up - down) * (up - down) / greatest(up + down, 1)) * 2, 12)) AS p_raw, CASE metric WHEN 'ezr' THEN 'ezr' ELSE 'grid' END AS source FROM t),
fam1 AS (SELECT *, least(1.0::DOUBLE, max((m - r + 1) * p_raw) OVER (PARTITION BY source ORDER BY r ROWS UNBOUNDED PRECEDING)) AS p_own FROM (SELECT *, count(*) OVER (PARTITION BY source) AS m, row_number() OVER (PARTITION BY source ORDER BY p_raw, metric, engine, slice) AS r FROM p)),
fam AS (SELECT *, least(1.0::DOUBLE, max((m2 - r2 + 1) * p_raw) OVER (ORDER BY r2 ROWS UNBOUNDED PRECEDING)) AS p_all FROM (SELECT *, count(*) OVER () AS m2, row_number() OVER (ORDER BY p_raw, metric, engine, slice) AS r2 FROM fam1))"""


def sign_tests(spark: SparkSession, d: str) -> DataFrame:
    """Paired tests of two metrics in all sectors by a bound on the number of wins, tagged with their source."""
    rows = M.query_engine(spark, d)
    out = []
    for metric, value in (("ezr", M.ezr().cast("double")), ("p10", M.precision(10))):
        scores = rows.select("query_id", "engine", "sector", "tier", value.alias("score"))
        diffs = P.slices(T.paired(scores, FOCAL)).filter(~F.col("slice").isin("simple", "medium", "complex"))
        out.append(diffs.groupBy("engine", "slice").agg(F.count_if(F.col("diff") > 0).alias("up"), F.count_if(F.col("diff") < 0).alias("down")).withColumn("metric", F.lit(metric)))
    d2 = (F.col("up") - F.col("down")) * (F.col("up") - F.col("down"))
    p = F.least(F.lit(1.0), F.round(F.exp(-2.0 * d2 / F.greatest(F.col("up") + F.col("down"), F.lit(1))) * 2, 12))
    return T.families(ezr=out[0].withColumn("p_raw", p), grid=out[1].withColumn("p_raw", p))


def family_rows(spark: SparkSession, d: str) -> DataFrame:
    """Significance within each source's family and within their union."""
    tie = ["metric", "engine", "slice"]
    own = T.holm(sign_tests(spark, d), ["source"], tie).withColumnsRenamed({"p_holm": "p_own", "significant": "significant_own"})
    return T.holm(own, [], tie).withColumnsRenamed({"p_holm": "p_all", "significant": "significant_all"})


@query(_FAMILY + " SELECT source, metric, engine, slice, round(p_own, 9) AS p_own, round(p_all, 9) AS p_all FROM fam")
def st6_families(spark: SparkSession, d: str) -> DataFrame:
    return family_rows(spark, d).select("source", "metric", "engine", "slice", F.round("p_own", 9).alias("p_own"), F.round("p_all", 9).alias("p_all"))


@query(_FAMILY + " SELECT source, metric, engine, slice, CASE WHEN p_all < 0.05 THEN 'gained' ELSE 'lost' END AS direction FROM fam WHERE (p_own < 0.05) <> (p_all < 0.05)")
def st7_flips(spark: SparkSession, d: str) -> DataFrame:
    """Tests whose significance depends on the size of the family."""
    return T.flips(family_rows(spark, d), "significant_own", "significant_all").select("source", "metric", "engine", "slice", "direction")


@query(_FAMILY + " SELECT metric, engine, slice, round(p_own, 9) AS p_own FROM fam WHERE metric LIKE 'p%' AND slice IN ('overall', 'BUILDING')")
def f11_metric_filters(spark: SparkSession, d: str) -> DataFrame:
    """Tests by prefix and by membership."""
    rows = family_rows(spark, d).filter(F.col("metric").startswith("p") & F.col("slice").isin("overall", "BUILDING"))
    return rows.select("metric", "engine", "slice", F.round("p_own", 9).alias("p_own"))


@query(
    _FAMILY + " SELECT row_number() OVER (ORDER BY metric, CASE slice WHEN 'overall' THEN 0 ELSE 1 END, slice, engine) AS place, metric, slice, engine, printf('%+.2f', round((up - down) / greatest(up + down, 1), 4) * 100) AS points FROM fam"
)
def t08_report_order(spark: SparkSession, d: str) -> DataFrame:
    """Tests in the report's order with percentages as text."""
    rows = family_rows(spark, d)  # a few dozen rows
    share = F.round((F.col("up") - F.col("down")) / F.greatest(F.col("up") + F.col("down"), F.lit(1)), 4)
    order = Window.orderBy("metric", F.when(F.col("slice") == "overall", 0).otherwise(1), "slice", "engine")
    return rows.select(F.row_number().over(order).alias("place"), "metric", "slice", "engine", R.percent_text(share, signed=True).alias("points")).orderBy("place")


@query(_FAMILY + " SELECT metric, engine, slice, printf('%.6f', round(p_raw, 9)) AS p_raw, true AS aligned FROM fam")
def j15_aligned_p(spark: SparkSession, d: str) -> DataFrame:
    """Tests written with six decimals (K6), read as text, and their p-values aligned by key with the run's."""
    keys = ["metric", "engine", "slice"]
    run = family_rows(spark, d).select(*keys, F.round("p_raw", 9).alias("p_raw"))
    path = sinks.new_path(spark, "tests")
    sinks.write_table(run, path, keys, digits=6)
    both = readers.csv_strings(spark, path).join(run.withColumnRenamed("p_raw", "now"), keys, "left")
    return both.select(*keys, "p_raw", (F.abs(F.col("p_raw").cast("double") - F.col("now")) <= 5e-7).alias("aligned"))


_POLICY = _HIT + """, g AS (SELECT *, CASE WHEN engine = 'focal' THEN gain_b ELSE gain_code END AS g0 FROM both2),
c AS (SELECT query_id, norm_id, max(g0) AS hi, min(g0) AS lo FROM g GROUP BY ALL), hx AS (SELECT g.*, c.hi, c.lo FROM g JOIN c USING (query_id, norm_id))"""


@query(
    _POLICY + _metrics("hx", "hi", "_hi") + _metrics("hx", "lo", "_lo")
    + "SELECT 'max' AS policy, r.engine, round(avg(f.p10 - r.p10), 9) AS diff FROM qe_hi r JOIN qe_hi f ON f.query_id = r.query_id AND f.engine = 'focal' AND r.engine <> 'focal' GROUP BY ALL"
    + " UNION ALL SELECT 'min', r.engine, round(avg(f.p10 - r.p10), 9) FROM qe_lo r JOIN qe_lo f ON f.query_id = r.query_id AND f.engine = 'focal' AND r.engine <> 'focal' GROUP BY ALL"
)
def st8_tie_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Differences under the extreme choices among a product's judgments."""
    hits = P.two_sets(spark, d).withColumn("gain_code", F.when(F.col("engine") == FOCAL, A.gain_of(F.col("label_b"))).otherwise(F.col("gain_code")))
    own = Window.partitionBy("query_id", "norm_id")
    out = []
    for policy, f in (("max", F.max), ("min", F.min)):
        rows = M.query_engine(spark, d, hits.withColumn("gain_code", f("gain_code").over(own))).select("query_id", "engine", M.precision(10).alias("score"))
        out.append(T.paired(rows, FOCAL).groupBy("engine").agg(F.round(F.avg("diff"), 9).alias("diff")).withColumn("policy", F.lit(policy)))
    return out[0].unionByName(out[1])


@query(_QE + "SELECT count(*) FILTER (idcg10 = 0 AND n_exact > 0) AS outside, count(*) FILTER (idcg10 = 0) AS n_ndcg_excluded, count(*) FILTER (n_exact = 0) AS n_recall_excluded FROM qe WHERE engine = 'focal'")
def u05_subset(spark: SparkSession, d: str) -> DataFrame:
    """Queries left out of nDCG are among those left out of recall."""
    rows = M.query_engine(spark, d).filter(F.col("engine") == FOCAL)
    a, b = rows.filter("idcg10 = 0").select("query_id"), rows.filter("n_exact = 0").select("query_id")
    outside = a.join(b, "query_id", "left_anti").agg(F.count("*").alias("outside"))
    counts = rows.agg(F.count_if(F.col("idcg10") == 0).alias("n_ndcg_excluded"), F.count_if(F.col("n_exact") == 0).alias("n_recall_excluded"))
    return outside.join(F.broadcast(counts), F.lit(True))


@query(_HIT + "SELECT query_id, count(DISTINCT engine) AS n_engines, false AS complete FROM hit GROUP BY query_id HAVING count(DISTINCT engine) <> 5")
def u06_engine_sets(spark: SparkSession, d: str) -> DataFrame:
    """Queries whose hits don't come from all engines."""
    per = judged_hit(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_set("engine")).alias("e"))
    return per.withColumn("complete", F.col("e") == F.array_sort(F.array(*map(F.lit, ENGINES)))).filter("NOT complete").select("query_id", F.size("e").cast("long").alias("n_engines"), "complete")


HEADLINES = ("n_hits", "ndcg_excluded", "recall_excluded", "zero", "all_junk")


def headlines(spark: SparkSession, d: str) -> DataFrame:
    """(name, value, n) of a run's headline figures; n is the number of queries."""
    rows = M.query_engine(spark, d)
    focal = F.col("engine") == FOCAL
    wide = rows.agg(F.sum("n_hits").alias("n_hits"), F.count_if(focal & (F.col("idcg10") == 0)).alias("ndcg_excluded"), F.count_if(focal & (F.col("n_exact") == 0)).alias("recall_excluded"), F.sum(M.zero()).alias("zero"), F.sum(M.all_junk()).alias("all_junk"), F.count_if(focal).alias("n"))
    return wide.unpivot(["n"], list(HEADLINES), "name", "value")


@query(
    _QE + ", g AS (SELECT count(*) FILTER (engine = 'focal') AS n, CAST(sum(n_hits) AS BIGINT) AS n_hits, count(*) FILTER (engine = 'focal' AND idcg10 = 0) AS ndcg_excluded, count(*) FILTER (engine = 'focal' AND n_exact = 0) AS recall_excluded, count(*) FILTER (zero) AS zero, count(*) FILTER (junk_only) AS all_junk FROM qe),"
    " l AS (UNPIVOT g ON n_hits, ndcg_excluded, recall_excluded, zero, all_junk INTO NAME name VALUE got) SELECT name, got, got AS want, TRUE AS passes FROM l"
)
def g01_headlines(spark: SparkSession, d: str) -> DataFrame:
    """Headline figures of the metric plans against those of the hits themselves, counted by differences of sets."""
    return G.compared(headlines(spark, d).drop("n"), expected_headlines(judged_hit(spark, d), query_table(spark, d)), ["name"])


def expected_headlines(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """(name, value) of a run of any size, without grid, pools or metrics: hits are counted, and sets taken from each other."""
    queries = asked.select("query_id")
    pairs = hits.select("query_id", "engine").distinct().hint("merge")
    # merged: files of hits are far smaller than their rows, so that Spark would send all of them through the driver
    relevant, exact = hits.filter("gain_code > 0").hint("merge"), hits.filter("gain_code = 100").hint("merge")
    counts = {
        "n_hits": hits,
        "ndcg_excluded": queries.join(relevant, "query_id", "left_anti"),
        "recall_excluded": queries.join(exact, "query_id", "left_anti"),
        "zero": queries.crossJoin(F.broadcast(hits.sparkSession.createDataFrame([(e,) for e in ENGINES], "engine string"))).join(pairs, ["query_id", "engine"], "left_anti"),
        "all_junk": pairs.join(relevant, ["query_id", "engine"], "left_anti"),
    }
    out = None
    for name, rows in counts.items():
        one = rows.agg(F.count("*").alias("value")).select(F.lit(name).alias("name"), "value")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    _AGG + ", c AS (SELECT engine, round(sum(zero_pct * n_queries) / sum(n_queries), 6) AS got FROM agg GROUP BY engine), w AS (SELECT engine, avg(CAST(zero AS INT)) * 100 AS exact FROM qe GROUP BY engine)"
    " SELECT engine, got, floor(exact * 100 + 1e-9::DOUBLE) / 100 AS want, abs(got - floor(exact * 100 + 1e-9::DOUBLE) / 100) <= 0.005::DOUBLE OR abs(floor(got * 100) / 100 - floor(exact * 100 + 1e-9::DOUBLE) / 100) < 1e-9::DOUBLE AS passes FROM c JOIN w USING (engine)"
)
def g03_chart_gate(spark: SparkSession, d: str) -> DataFrame:
    """Rates recombined from rounded cells against truncated ones from the queries: equal within half a hundredth or when cut."""
    got = P.a16_recombined(spark, d).select("engine", F.col("zero_pct").alias("value"))
    want = M.query_engine(spark, d).groupBy("engine").agg((F.floor(F.avg(M.zero()) * 100 * 100 + 1e-9) / 100).alias("value"))
    return G.compared(got, want, ["engine"], 0.005, truncated=True)


@query(_AGG + ", c AS (SELECT engine, round(sum(p10_pct * n_queries) / sum(n_queries), 6) AS got FROM agg GROUP BY engine), w AS (SELECT engine, round(avg(p10) * 100, 6) AS want FROM qe GROUP BY engine) SELECT engine, got, want, abs(got - want) <= 0.05::DOUBLE AS passes FROM c JOIN w USING (engine)")
def g04_recombination(spark: SparkSession, d: str) -> DataFrame:
    """Two ways to the same mean: recombined cells and all queries, within 0.05 points."""
    got = P.a16_recombined(spark, d).select("engine", F.col("p10_pct").alias("value"))
    want = M.query_engine(spark, d).groupBy("engine").agg(F.round(F.avg(M.precision(10)) * 100, 6).alias("value"))
    return G.compared(got, want, ["engine"], 0.05)


@query("SELECT source, n, 0::BIGINT AS other_seed, 0::BIGINT AS other_replicates, n = want AS passes FROM (SELECT 'ezr' AS source, (SELECT count(DISTINCT c_mktsegment) + 4 FROM customer) * 4 AS n, 36 AS want)")
def g06_provenance(spark: SparkSession, d: str) -> DataFrame:
    """A family has all of its tests, one seed and 10,000 replicates each."""
    tests = T.families(ezr=P.st4_ezr_bootstrap(spark, d).withColumn("seed", F.lit(42)))
    return G.provenance(tests, {"ezr": 36}, 42, 10_000)


@query("SELECT true AS same")
def g07_content(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue written and read in another order has the same content."""
    rows = table(spark, d, "part")
    path = sinks.new_path(spark, "content")
    rows.repartition(7, "p_size").write.parquet(path)
    return G.same_content(rows, spark.read.parquet(path))


@query(_AGG + "SELECT engine, sector, tier, zero_pct, p10_pct, p20_pct, n_queries, true AS passes FROM agg")
def j14_committed_run(spark: SparkSession, d: str) -> DataFrame:
    """A run against the table that an earlier one committed as CSV (K5, S10): the same rows within 1e-9."""
    path = sinks.new_path(spark, "aggregates")
    run = P.aggregate_rows(spark, d)
    keys = ["engine", "sector", "tier"]
    sinks.write_table(run, path, keys)
    old = readers.typed_csv(spark, path, "engine string, sector string, tier string, zero_pct double, p10_pct double, p20_pct double, n_queries long")
    both = run.join(old.toDF(*[c if c in keys else f"old_{c}" for c in old.columns]), keys, "full")
    near = F.lit(True)
    for c in ("zero_pct", "p10_pct", "p20_pct", "n_queries"):
        near = near & (F.abs(F.col(c) - F.col(f"old_{c}")) <= 1e-9)
    return both.select(*run.columns, F.coalesce(near, F.lit(False)).alias("passes"))


@query(_HIT + "SELECT query_id, sector, engine, rank AS position, raw_id AS id, label FROM labelled")
def s02_sector_files(spark: SparkSession, d: str) -> DataFrame:
    """Judged results written as one file of nested JSON arrays per sector, read as many files with the sector from each name."""
    hits = judged_hit(spark, d)
    hit = F.struct("rank", F.col("raw_id").alias("id"), "label")
    per = hits.groupBy("query_id", "sector", "tier", "engine").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    entry = per.groupBy("query_id", "sector", "tier").agg(F.map_from_entries(F.collect_list(F.struct("engine", F.struct("hits")))).alias("providers"))
    rows = entry.select("sector", F.col("query_id").cast("string").alias("query_id"), F.col("sector").alias("category"), F.col("tier").alias("complexity"), F.lit("q").alias("text_query"), "providers")
    root = sinks.new_path(spark, "judged")
    # every second sector packed, and with white space between
    even = F.crc32(F.col("sector").cast("binary")) % 2 == 0
    paths = sinks.write_arrays(spark, rows.filter(even), "sector", ["query_id"], root, pretty=True) + sinks.write_arrays(spark, rows.filter(~even), "sector", ["query_id"], root, gzip=True)
    whole = readers.sector_files(spark, paths)
    flat = readers.flattened(whole)
    return flat.select(F.col("query_id").cast("long").alias("query_id"), "sector", "engine", "position", "id", "label")


@query("SELECT event_id, event_type FROM events WHERE event_id % 7 <> 0")
def s05_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines with blank and broken lines between."""
    line = F.when(F.col("event_id") % 7 == 0, F.when(F.col("event_id") % 2 == 0, "").otherwise('{"event_id": ')).otherwise(F.to_json(F.struct("event_id", "event_type")))
    path = sinks.new_path(spark, "lines")
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    return readers.json_lines(spark, path, "event_id long, event_type string")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, 'é ' || p_brand AS brand FROM part WHERE p_partkey % 9 <> 0")
def s06_latin1_csv(spark: SparkSession, d: str) -> DataFrame:
    """A CSV file in Latin-1 with ragged lines: read as text columns, bad lines skipped."""
    path = sinks.new_path(spark, "latin")
    row = F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name", F.concat(F.lit("é "), "p_brand"), F.when(F.col("p_partkey") % 9 == 0, "too,many"))
    lines = table(spark, d, "part").select(row.alias("id,title,brand"))  # the column's name is the head
    lines.write.option("encoding", "ISO-8859-1").option("header", True).csv(path, quote="", sep="\t", escape="")
    return readers.csv_any_encoding(spark, path)


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 1 THEN p_brand END AS style FROM part")
def s08_side_files(spark: SparkSession, d: str) -> DataFrame:
    """Rows joined to one JSON file each: there for some, broken for some, absent for the rest."""
    path = sinks.new_path(spark, "styles")
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_brand")
    kind = F.col("id").cast("long") % 5
    files = rows.filter(kind.isin(1, 2)).select("id", F.when(kind == 1, F.to_json(F.struct(F.col("p_brand").alias("style")))).otherwise('{"style": ').alias("value"))
    sinks.write_files(spark, files, "id", "value", path, rows.count())
    side = readers.side_files(spark, path, "style string", readers.NAMED)
    return readers.with_side_files(rows, side, "id").select(F.col("id").cast("long").alias("id"), F.col("side.style").alias("style"))


@query(_HIT + "SELECT CAST(query_id AS VARCHAR) AS query_id, sector, tier, CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw_id) AS INTEGER) AS position, raw_id AS product_id, label FROM (SELECT DISTINCT query_id, sector, tier, raw_id, label FROM labelled WHERE engine = 'focal')")
def s09_rejudged(spark: SparkSession, d: str) -> DataFrame:
    """A folder of re-judgments with parallel lists, one row per product."""
    own = judged_hit(spark, d).filter(F.col("engine") == FOCAL).select("query_id", "sector", "tier", "raw_id", "label").distinct()
    per = own.groupBy("query_id", "sector", "tier").agg(F.array_sort(F.collect_list(F.struct("raw_id", "label"))).alias("x"))
    lists = per.select(F.col("query_id").cast("string").alias("query_id"), "sector", "tier", F.col("x.raw_id").alias("product_ids"), F.col("x.label").alias("labels"), F.transform("x", lambda _: F.lit("r")).alias("reasonings"))
    path = sinks.new_path(spark, "raw")
    files = lists.select(F.col("query_id").alias("file"), F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))
    sinks.write_files(spark, files, "file", "value", path, query_table(spark, d).count())
    return readers.rejudged(spark, path).drop("reasoning")


COLUMNS = ("product_id", "sector", "title", "price")


def catalogue_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_retailprice").alias("price"), F.col("p_name").alias("title"), F.lit("s").alias("sector"), S.namespaced(F.lit("s"), F.col("p_partkey").cast("string")).alias("product_id"), F.when(F.col("p_partkey") % 3 == 0, None).otherwise(F.col("p_brand")).alias("brand"))


@query("SELECT 's:' || p_partkey AS product_id, 's' AS sector, p_name AS title, p_retailprice AS price FROM part")
def k01_catalogue(spark: SparkSession, d: str) -> DataFrame:
    path = sinks.new_path(spark, "catalogue")
    sinks.write_catalogue(catalogue_rows(spark, d), COLUMNS, path)
    back = spark.read.parquet(path)
    if tuple(back.columns) != COLUMNS:
        raise ValueError("columns are not in order")
    return back


@query("SELECT 's:' || p_partkey AS product_id, p_name AS title FROM part ORDER BY 's:' || p_partkey LIMIT 300")
def k02_sample(spark: SparkSession, d: str) -> DataFrame:
    """The first 300 rows as CSV: the limit is what the sink is."""
    path = sinks.new_path(spark, "sample")
    sinks.write_sample(catalogue_rows(spark, d).select("product_id", "title"), ["product_id"], path)
    return readers.csv_strings(spark, path)


@query("SELECT 's:' || p_partkey AS product_id, p_name AS title, p_retailprice AS price, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS brand FROM part")
def k03_json(spark: SparkSession, d: str) -> DataFrame:
    rows = catalogue_rows(spark, d).select("product_id", "title", "price", "brand")
    path = sinks.new_path(spark, "json")
    sinks.write_json_lines(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("SELECT 's:' || p_partkey AS product_id, p_name AS title FROM part")
def k04_keyed(spark: SparkSession, d: str) -> DataFrame:
    """An upload keyed by id, read back as its entries."""
    path = sinks.new_path(spark, "keyed")
    sinks.write_keyed(catalogue_rows(spark, d).select("product_id", "title"), "product_id", path)
    lines = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,struct<title:string>>")).alias("product_id", "item"))
    return lines.select("product_id", "item.title")


@query(_HIT + "SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'new' ELSE 'old' END AS run, count(*) AS n FROM hit GROUP BY ALL")
def k07_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Finished queries written once, some again: these are replaced, all others stay."""
    per = judged_hit(spark, d).groupBy("query_id").agg(F.count("*").alias("n"))
    path = sinks.new_path(spark, "finished")
    sinks.append_finished(per.select("n", F.lit("old").alias("run"), (F.col("query_id") % 8).alias("part"), "query_id"), path, "part")
    sinks.append_finished(per.filter("query_id % 2 = 0").select("n", F.lit("new").alias("run"), (F.col("query_id") % 8).alias("part"), "query_id"), path, "part")
    return spark.read.parquet(path).select("query_id", "run", "n")


@query(_HIT + "SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'first' ELSE 'second' END AS run FROM qs WHERE query_id % 3 = 0 OR query_id % 5 <> 0")
def k08_write_once(spark: SparkSession, d: str) -> DataFrame:
    """A cache: what is there stays, failures lie apart and are tried again."""
    q = query_table(spark, d).select("query_id")
    path = sinks.new_path(spark, "cache")
    row = lambda df, run, ok: df.select("query_id", F.lit(run).alias("run"), ok.alias("ok"))
    sinks.write_once(spark, row(q, "first", F.col("query_id") % 3 == 0), "query_id", F.col("ok"), path)
    return sinks.write_once(spark, row(q, "second", F.col("query_id") % 5 != 0), "query_id", F.col("ok"), path).select("query_id", "run")


def found(spark: SparkSession, d: str) -> DataFrame:
    """BM25 candidates (query_id, doc_id, norm_id, rank, coverage, code, failed) of the searches whose query has no exact product."""
    empty = M.query_engine(spark, d).filter((F.col("engine") == FOCAL) & (F.col("n_exact") == 0)).select("query_id")
    asked = P.searches(spark, d).join(empty, "query_id", "left_semi")
    rows = search(spark, P.index(spark, d), asked)
    cover = F.round(F.when(F.col("n_terms") == 0, 0.0).otherwise(F.col("matched") / F.col("n_terms")), 9)
    h = (F.col("query_id") * 31 + F.col("doc_id") * 17) % 100
    code = F.when(h < 3, 100).when(h < 5, 10).when(h < 7, 1).otherwise(0)
    return rows.select("query_id", "doc_id", F.format_string("p00%02d", F.col("doc_id") % 60).alias("norm_id"), "rank", cover.alias("coverage"), F.when(F.col("query_id") % 3 == 0, 0).otherwise(code).alias("code"), ((F.col("doc_id") * 7 + F.col("query_id")) % 10 == 0).alias("failed"))


_FOUND = _QE + ", " + _BM.strip().removeprefix("WITH ") + f""", empty AS (SELECT query_id FROM qe WHERE engine = 'focal' AND n_exact = 0),
back AS (SELECT query_id, norm_id, max(gain_code) AS og, arg_max(label, (gain_code, -rank, engine)) AS ol FROM labelled GROUP BY ALL),
cand AS (SELECT t.query_id, t.doc_id, t.rank, 'p00' || lpad(CAST(t.doc_id % 60 AS VARCHAR), 2, '0') AS norm_id,
  round(CASE WHEN len(list_distinct({_TOK.format('b.text')})) = 0 THEN 0 ELSE len(list_intersect(list_distinct({_TOK.format('b.text')}), {_TOK.format(_TITLED.replace('source', 'x.source').replace('text', 'x.text'))})) / len(list_distinct({_TOK.format('b.text')})) END, 9) AS coverage,
  CASE WHEN t.query_id % 3 = 0 THEN 0 WHEN (t.query_id * 31 + t.doc_id * 17) % 100 < 3 THEN 100 WHEN (t.query_id * 31 + t.doc_id * 17) % 100 < 5 THEN 10 WHEN (t.query_id * 31 + t.doc_id * 17) % 100 < 7 THEN 1 ELSE 0 END AS code, (t.doc_id * 7 + t.query_id) % 10 = 0 AS failed
 FROM top t JOIN empty USING (query_id) JOIN benchmark b ON b.item_id = t.query_id JOIN documents x ON x.doc_id = t.doc_id),
rich AS (SELECT c.*, og IS NOT NULL AS was_returned, ol AS original_label FROM cand c LEFT JOIN back USING (query_id, norm_id))"""


@query(_FOUND + " SELECT query_id, doc_id, rank, coverage, was_returned, original_label FROM rich")
def c02_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with what the engines returned of them."""
    return J.enriched(found(spark, d), judged_hit(spark, d)).select("query_id", "doc_id", "rank", "coverage", "was_returned", "original_label")


_CLASS = _FOUND + """, per AS (SELECT query_id, count(*) FILTER (code = 100 AND NOT failed AND NOT was_returned) AS n_fresh, count(*) FILTER (code = 100 AND NOT failed AND was_returned) AS n_stale, max(code) FILTER (NOT failed) AS best_new, max(coverage) AS best_coverage, count(*) AS n_candidates, count(*) FILTER (failed) AS n_failed FROM rich GROUP BY query_id),
bo AS (SELECT query_id, max(gain_code) AS best_original FROM hit GROUP BY query_id),
cls AS (SELECT e.query_id, coalesce(n_fresh, 0) AS n_fresh, coalesce(n_stale, 0) AS n_stale, coalesce(n_candidates, 0) AS n_candidates, coalesce(best_new, 0) AS best_new, coalesce(best_original, 0) AS best_original,
 CASE WHEN n_fresh > 0 THEN 'engines-missed' WHEN n_stale > 0 THEN 'inconclusive' WHEN coalesce(best_new, 0) IN (1, 10) OR coalesce(best_original, 0) IN (1, 10) THEN 'partial' WHEN coalesce(n_candidates, 0) >= 10 AND best_coverage >= 0.5 AND n_failed / n_candidates <= 0.3 THEN 'catalog-gap' ELSE 'inconclusive' END AS audit_class FROM empty e LEFT JOIN per USING (query_id) LEFT JOIN bo USING (query_id))"""


def classes(spark: SparkSession, d: str) -> DataFrame:
    hits = judged_hit(spark, d)
    empty = M.query_engine(spark, d).filter((F.col("engine") == FOCAL) & (F.col("n_exact") == 0)).select("query_id", "sector")
    return J.audited(empty, J.enriched(found(spark, d), hits), hits)


@query(_CLASS + " SELECT query_id, audit_class, n_fresh, n_stale, n_candidates, best_new, best_original FROM cls")
def c01_audit_class(spark: SparkSession, d: str) -> DataFrame:
    return classes(spark, d).select("query_id", "audit_class", "n_fresh", "n_stale", "n_candidates", "best_new", "best_original")


@query(_CLASS + " SELECT query_id, audit_class FROM cls")
def c03_reclassified(spark: SparkSession, d: str) -> DataFrame:
    """Classes from stored candidates and judgments, with the join to returned products made anew."""
    path = sinks.new_path(spark, "audit")
    found(spark, d).write.parquet(path)
    hits = judged_hit(spark, d)
    empty = M.query_engine(spark, d).filter((F.col("engine") == FOCAL) & (F.col("n_exact") == 0)).select("query_id", "sector")
    return J.audited(empty, J.enriched(spark.read.parquet(path), hits), hits).select("query_id", "audit_class")


AUDIT_CLASSES = ("engines-missed", "partial", "catalog-gap", "inconclusive")


@query(
    _CLASS + ", s AS (SELECT DISTINCT sector FROM qs) SELECT s.sector, "
    + ", ".join(f"""count(*) FILTER (audit_class = '{c}') AS "{c}\"""" for c in AUDIT_CLASSES)
    + " FROM s LEFT JOIN (SELECT cls.*, qs.sector FROM cls JOIN qs USING (query_id)) c ON c.sector = s.sector GROUP BY s.sector"
)
def a32_class_by_sector(spark: SparkSession, d: str) -> DataFrame:
    """Audit classes by sector, zeros included."""
    wide = classes(spark, d).groupBy("sector").pivot("audit_class", list(AUDIT_CLASSES)).count()
    return query_table(spark, d).select("sector").distinct().join(wide, "sector", "left").na.fill(0)


@query(_FOUND + " SELECT query_id, arg_max(doc_id, (code, -rank)) AS doc_id, max(code) AS code FROM rich WHERE NOT failed GROUP BY query_id")
def t09_best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate of each query by gain, then by its BM25 rank."""
    return found(spark, d).filter("NOT failed").groupBy("query_id").agg(F.max_by("doc_id", F.struct("code", -F.col("rank"))).alias("doc_id"), F.max("code").alias("code"))


@query(_QE + "SELECT query_id FROM (SELECT DISTINCT query_id FROM hit WHERE engine = 'focal') EXCEPT SELECT query_id FROM hit WHERE engine = 'rival_a' AND gain_code = 100")
def u04_not_rejudged(spark: SparkSession, d: str) -> DataFrame:
    hits = judged_hit(spark, d)
    return hits.filter(F.col("engine") == FOCAL).select("query_id").distinct().exceptAll(hits.filter((F.col("engine") == "rival_a") & (F.col("gain_code") == 100)).select("query_id").distinct())


@query(_QE + ", r AS (SELECT engine, tier, avg(recall10) AS r10, count(recall10) AS k FROM qe GROUP BY ALL) SELECT engine, count(*) AS n_tiers, CAST(sum(k) AS BIGINT) AS n, round(sum(r10 * k) / sum(k), 9) AS recall10 FROM r GROUP BY engine")
def a13_rich_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Recall by tier as {rate, n} in one row per engine, recombined."""
    rows = M.query_engine(spark, d).groupBy("engine", "tier").agg(F.avg(M.recall(10)).alias("rate"), F.count(M.recall(10)).alias("n"))
    per = rows.groupBy("engine").agg(F.map_from_entries(F.collect_list(F.struct("tier", F.struct("rate", "n")))).alias("by_tier"))
    cells = F.map_values("by_tier")
    total = F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a + c["n"])
    weighted = F.aggregate(F.array_sort(cells), F.lit(0.0), lambda a, c: a + c["rate"] * c["n"])
    return per.select("engine", F.size("by_tier").cast("long").alias("n_tiers"), total.alias("n"), F.round(weighted / total, 9).alias("recall10"))
