"""Named queries by operator: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevara.functions import scalars as S
from relevara.operators import agreement as A
from relevara.operators import metrics as M
from relevara.operators import stats as T
from relevara.operators.inverted_index import Index, build, search
from relevara.operators.judged import ENGINES, grid, ideal, judged_hit, pool, table
from relevara.operators.judged import queries as query_table
from relevara.operators.retrieval import bm25, idf, product_text
from relevara.sources.readers import nested
from relevara.sources.sinks import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FOCAL = ENGINES[0]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def s03_flattened(spark: SparkSession, d: str) -> DataFrame:
    """Packed into nested results and flattened again."""
    per = nested(judged_hit(spark, d)).select("query_id", "sector", "tier", F.explode("providers").alias("engine", "hits"))
    return per.select("query_id", "sector", "tier", "engine", F.explode("hits").alias("h")).select("query_id", "sector", "tier", "engine", "h.rank", F.col("h.id").alias("raw_id"), "h.label")


@query
def a01_pool_max_gain(spark: SparkSession, d: str) -> DataFrame:
    return pool(judged_hit(spark, d))


@query
def a02_idcg(spark: SparkSession, d: str) -> DataFrame:
    return ideal(judged_hit(spark, d)).drop("n_exact")


@query
def a03_pooled_ndcg(spark: SparkSession, d: str) -> DataFrame:
    rows = M.query_engine(spark, d).filter("idcg10 > 0")
    return rows.groupBy("engine").agg(F.count("*").alias("n"), M.mean(M.ndcg(10)).alias("ndcg10"), M.mean(M.ndcg(20)).alias("ndcg20"))


@query
def a04_self_ndcg(spark: SparkSession, d: str) -> DataFrame:
    own = M.self_ideal(judged_hit(spark, d), 10)
    return grid(spark, d).join(own, ["query_id", "engine"], "left").groupBy("engine").agg(M.mean(F.coalesce("score", F.lit(0.0))).alias("self_ndcg10"), F.count("*").alias("n"))


@query
def a05_graded_precision(spark: SparkSession, d: str) -> DataFrame:
    return M.query_engine(spark, d).select("query_id", "engine", M.precision(10).alias("p10"), M.precision(20).alias("p20"))


@query
def a06_pooled_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = M.query_engine(spark, d).filter("n_exact > 0")
    return rows.select("query_id", "engine", M.recall(10).alias("recall10"), M.recall(20).alias("recall20"))


@query
def a08_cells(spark: SparkSession, d: str) -> DataFrame:
    m = [("ndcg10", M.ndcg(10)), ("ndcg20", M.ndcg(20)), ("p10", M.precision(10)), ("p20", M.precision(20)), ("recall10", M.recall(10)), ("recall20", M.recall(20)), ("ezr", M.ezr()), ("zero_rate", M.zero()), ("all_junk", M.all_junk()), ("junk10", M.junk(10)), ("junk20", M.junk(20)), ("nrel", F.col("nrel"))]
    return M.cells(M.query_engine(spark, d), *[M.mean(x).alias(n) for n, x in m])


@query
def a07_ezr_disjoint(spark: SparkSession, d: str) -> DataFrame:
    """Effective zero results are zero results or all junk, never both."""
    rows = M.query_engine(spark, d)
    out = rows.groupBy("engine").agg(F.sum(M.ezr()).alias("n_ezr"), F.sum(M.zero()).alias("n_zero"), F.sum(M.all_junk()).alias("n_junk"), F.count("*").alias("n"))
    return out.withColumn("holds", F.col("n_ezr") == F.col("n_zero") + F.col("n_junk"))


@query
def a14_recall_by_tier(spark: SparkSession, d: str) -> DataFrame:
    rows = M.query_engine(spark, d).filter("n_exact > 0")
    long = rows.select("engine", "tier", F.explode(F.array(F.struct(F.lit(10).alias("k"), M.recall(10).alias("r")), F.struct(F.lit(20).alias("k"), M.recall(20).alias("r")))).alias("x"))
    return long.groupBy("engine", F.col("x.k").alias("k"), "tier").agg(M.mean(F.col("x.r")).alias("rate"), F.count("*").alias("n"))


def aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Sums of whole numbers, so that two decimals come out alike whatever the order."""
    rows = M.query_engine(spark, d)
    p = lambda k: F.sum(F.round(M.precision(k) * 10000).cast("long")).alias(f"p{k}")
    return rows.groupBy("engine", "sector", "tier").agg(F.sum(M.zero()).alias("zero"), p(10), p(20), F.count("*").alias("n_queries"))


def hundredths(total: str, factor: int) -> Column:
    """100 * total / (n_queries * factor) with two decimals, halves up."""
    return F.expr(f"(20000 * {total} + n_queries * {factor}) div (2 * n_queries * {factor})") / 100


def aggregate_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = aggregates(spark, d)
    return rows.select("engine", "sector", "tier", hundredths("zero", 1).alias("zero_pct"), hundredths("p10", 10000).alias("p10_pct"), hundredths("p20", 10000).alias("p20_pct"), "n_queries")


@query
def a15_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return aggregate_rows(spark, d).orderBy("engine", "sector", "tier")


@query
def a16_recombined(spark: SparkSession, d: str) -> DataFrame:
    n = F.sum("n_queries")
    w = lambda c: F.round(F.sum(F.col(c) * F.col("n_queries")) / n, 6).alias(c)
    return aggregate_rows(spark, d).groupBy("engine").agg(w("zero_pct"), w("p10_pct"), w("p20_pct"), n.alias("n_queries"))


@query
def a17_label_census(spark: SparkSession, d: str) -> DataFrame:
    return judged_hit(spark, d).groupBy("label").agg(F.count("*").alias("n"))


@query
def a18_populations(spark: SparkSession, d: str) -> DataFrame:
    rows = M.query_engine(spark, d).filter(F.col("engine") == FOCAL)
    return rows.groupBy("sector", "tier").agg(F.count("*").alias("n_all"), F.count_if(F.col("idcg10") > 0).alias("n_ndcg"), F.count_if(F.col("n_exact") > 0).alias("n_recall"), F.count_if((F.col("idcg10") > 0) & (F.col("n_exact") == 0)).alias("n_between"))


def median_cents(prices: DataFrame, by: list[str]) -> DataFrame:
    """(by, median) of ``cents``, halves up, from a histogram: no buffer holds all values."""
    counts = prices.groupBy(*by, "cents").agg(F.count("*").alias("k"))
    own = Window.partitionBy(*by)
    placed = counts.withColumn("n", F.sum("k").over(own)).withColumn("upto", F.sum("k").over(own.orderBy("cents")))
    low, high = F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")
    at = lambda i: F.min(F.when(F.col("upto") >= i, F.col("cents")))
    return placed.groupBy(*by).agg(((at(low) + at(high) + 1) / 2).cast("long").alias("median"))


def median_filled(rows: DataFrame, by: str) -> DataFrame:
    """Where ``cents`` is 0, the median of its category's prices over 0, or else that of all prices."""
    known = rows.filter("cents > 0")
    per, every = median_cents(known, [by]), median_cents(known, []).withColumnRenamed("median", "overall")
    filled = rows.join(per, by, "left").join(F.broadcast(every), F.lit(True), "left")
    return filled.withColumn("cents", F.when(F.col("cents") == 0, F.coalesce("median", "overall")).otherwise(F.col("cents")))


@query
def a19_median_fill(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_type", F.when(F.col("p_partkey") % 7 == 0, 0).otherwise(F.round(F.col("p_retailprice") * 100)).cast("long").alias("cents"))
    return median_filled(part, "p_type").select("p_partkey", (F.col("cents") / 100).alias("price"))


def products(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue of parts with some fields blank."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(S.namespaced(F.lower("p_brand"), k.cast("string")).alias("product_id"), F.when(k % 11 == 0, " N/A ").otherwise(F.col("p_name")).alias("title"), F.when(k % 5 == 0, "nan").otherwise(F.col("p_brand")).alias("brand"), F.col("p_type").alias("category"), F.when(k % 13 == 0, None).otherwise(F.col("p_retailprice")).alias("price"))


@query
def a20_completeness(spark: SparkSession, d: str) -> DataFrame:
    rows = products(spark, d)
    text = [F.avg((S.clean_text(F.col(c)) != "").cast("int") * 100.0).alias(c) for c in ("product_id", "title", "brand", "category")]
    wide = rows.agg(*text, F.avg(F.col("price").isNotNull().cast("int") * 100.0).alias("price"))
    return wide.unpivot([], ["product_id", "title", "brand", "category", "price"], "field", "pct").select("field", F.round("pct", 1).alias("pct"))


#: Rows that each table must have for one customer.
ROWS_PER_CUSTOMER = {"part": 200 / 150, "orders": 10.0, "lineitem": 40.0}


@query
def a21_count_gate(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts against a table of expectations for the scale that the customers show."""
    got = None
    for name in ROWS_PER_CUSTOMER:
        one = table(spark, d, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        got = one if got is None else got.unionByName(one)
    scale = table(spark, d, "customer").agg(F.count("*").alias("customers"))
    per = F.create_map(*[F.lit(x) for kv in ROWS_PER_CUSTOMER.items() for x in kv])
    return count_gate(got.join(F.broadcast(scale), F.lit(True)), F.round(F.col("customers") * F.element_at(per, F.col("name"))).cast("long")).drop("customers")


def count_gate(counts: DataFrame, expected: Column) -> DataFrame:
    return counts.withColumn("expected", expected).withColumn("passes", F.col("n") == F.col("expected"))


@query
def a22_mapping_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = products(spark, d).withColumn("t", S.clean_text(F.col("title")))
    return rows.agg(F.count_if(F.col("t") == "").alias("skipped"), (F.count("*") - F.countDistinct("t")).alias("duplicate_titles"), F.count_if(F.col("price").isNull()).alias("price_defaulted"))


@query
def a23_id_mode(spark: SparkSession, d: str) -> DataFrame:
    ids = products(spark, d).select(S.last_segment(F.col("product_id")).alias("raw"), "product_id")
    mode = lambda c: F.when(F.bool_and(F.col(c).rlike("^-*[0-9]+$")), "int").otherwise("str")
    return ids.agg(mode("raw").alias("raw_mode"), mode("product_id").alias("product_mode"))


def two_sets(spark: SparkSession, d: str) -> DataFrame:
    return A.relabelled(judged_hit(spark, d), 31, 17, 12)


@query
def a24_confusion(spark: SparkSession, d: str) -> DataFrame:
    return A.confusion(two_sets(spark, d))


@query
def a25_kappa(spark: SparkSession, d: str) -> DataFrame:
    return A.kappa(two_sets(spark, d), [])


@query
def a26_gain_delta(spark: SparkSession, d: str) -> DataFrame:
    delta = A.gain_of(F.col("label_b")) - F.col("gain_code")
    return two_sets(spark, d).agg(F.round(F.sum(delta) / (F.count("*") * 100), 9).alias("mean_delta"), F.round(F.sum(F.abs(delta)) / (F.count("*") * 100), 9).alias("mean_abs_delta"))


@query
def a27_agreement_by_sector(spark: SparkSession, d: str) -> DataFrame:
    return A.kappa(two_sets(spark, d), ["sector"])


@query
def a28_metrics_by_label_set(spark: SparkSession, d: str) -> DataFrame:
    hits = two_sets(spark, d)
    out = []
    for name, code in (("a", F.col("gain_code")), ("b", A.gain_of(F.col("label_b")))):
        rows = M.query_engine(spark, d, hits.withColumn("gain_code", code))
        out.append(rows.groupBy("engine").agg(M.mean(M.ndcg(10)).alias("ndcg10"), M.mean(M.precision(10)).alias("p10"), M.mean(M.recall(10)).alias("recall10"), M.mean(M.ezr()).alias("ezr")).withColumn("label_set", F.lit(name)))
    return out[0].unionByName(out[1])


def collisions(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of raw ids of one product in a query: the few spellings meet inside one row."""
    hits = two_sets(spark, d).withColumn("label", F.when(F.col("engine") == FOCAL, F.col("label_b")).otherwise(F.col("label")))
    own = hits.groupBy("query_id", "sector", "norm_id", "raw_id").agg(F.min("label").alias("label"))
    per = own.groupBy("query_id", "sector", "norm_id").agg(F.array_sort(F.collect_list(F.struct("raw_id", "label"))).alias("s")).filter(F.size("s") > 1)
    a = per.select("query_id", "sector", "norm_id", "s", F.posexplode("s").alias("i", "a"))
    pairs = a.select("query_id", "sector", "norm_id", "a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    return pairs.select("query_id", "sector", "norm_id", F.col("a.raw_id").alias("raw_a"), F.col("b.raw_id").alias("raw_b"), F.col("a.label").alias("label_a"), F.col("b.label").alias("label_b"))


@query
def j08_collisions(spark: SparkSession, d: str) -> DataFrame:
    return collisions(spark, d).select("query_id", "norm_id", "raw_a", "raw_b", "label_a", "label_b")


@query
def a36_collision_summary(spark: SparkSession, d: str) -> DataFrame:
    return collisions(spark, d).groupBy("sector").agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_pairs"), F.count_if(F.col("label_a") == F.col("label_b")).alias("n_agree"))


@query
def a37_canonical_gain(spark: SparkSession, d: str) -> DataFrame:
    hits = two_sets(spark, d).withColumn("g", F.when(F.col("engine") == FOCAL, A.gain_of(F.col("label_b"))).otherwise(F.col("gain_code")))
    return hits.groupBy("query_id", "norm_id").agg(F.max("g").alias("by_max"), F.min("g").alias("by_min"), F.min_by("g", F.struct("engine", "rank")).alias("by_engine"))


@query
def a38_integrity(spark: SparkSession, d: str) -> DataFrame:
    hits = judged_hit(spark, d)
    twice = hits.groupBy("query_id", "engine", "norm_id").count().filter("count > 1").agg(F.count("*").alias("duplicates"))
    gains = hits.groupBy("query_id", "norm_id").agg(F.countDistinct("gain_code").alias("k")).filter("k > 1").agg(F.count("*").alias("inconsistent"))
    lost = hits.join(pool(hits).select("query_id", "norm_id"), ["query_id", "norm_id"], "left_anti").agg(F.count("*").alias("not_in_pool"))
    return twice.join(gains, F.lit(True)).join(lost, F.lit(True))


@query
def j05_paired_diffs(spark: SparkSession, d: str) -> DataFrame:
    scores = M.query_engine(spark, d).select("query_id", "engine", M.ezr().alias("score"))
    return T.paired(scores, FOCAL).groupBy("engine").agg(F.sum("diff").alias("total"), F.count_if(F.col("diff") < 0).alias("wins"), F.count_if(F.col("diff") > 0).alias("losses"), F.count("*").alias("n"))


@query
def j09_to_judge(spark: SparkSession, d: str) -> DataFrame:
    """Unique items of each query without those that are judged already."""
    hits = judged_hit(spark, d)
    cache = hits.filter(F.col("query_id") % 3 == 0).select("query_id", "raw_id").distinct()
    return hits.select("query_id", "raw_id").distinct().join(cache, ["query_id", "raw_id"], "left_anti")


@query
def j10_provider_merge(spark: SparkSession, d: str) -> DataFrame:
    """Engines of an earlier run stay unless the new run has them."""
    per = judged_hit(spark, d).groupBy("query_id", "engine").agg(F.count("*").alias("n"))
    old, new = per.filter(F.col("query_id") % 2 == 0), per.filter(F.col("engine") == FOCAL).withColumn("n", F.col("n") + 100)
    both = old.withColumnRenamed("n", "n_old").join(new.withColumnRenamed("n", "n_new"), ["query_id", "engine"], "full")
    return both.select("query_id", "engine", F.coalesce("n_new", "n_old").alias("n"))


@query
def w04_first_seen(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("query_id", "norm_id").orderBy("engine", "rank")
    return judged_hit(spark, d).withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("query_id", "norm_id", "engine", "rank")


@query
def w09_last_wins(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max(order).alias("m")).select("l_partkey", "m.l_orderkey", "m.l_linenumber", "m.l_extendedprice")


@query
def w12_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    h = (F.col("query_id") * 7919 + 42 * 104729) % 15485863
    order = Window.partitionBy("sector", "tier").orderBy(h, "query_id")
    return query_table(spark, d).withColumn("rn", F.row_number().over(order)).filter("rn <= 6").select("sector", "tier", "query_id")


def slices(rows: DataFrame) -> DataFrame:
    return rows.withColumn("slice", F.explode(F.array(F.lit("overall"), "sector", "tier"))).drop("sector", "tier")


def ezr_tests(spark: SparkSession, d: str, replicates: int = 10_000) -> tuple[DataFrame, DataFrame]:
    scores = M.query_engine(spark, d).select("query_id", "engine", "sector", "tier", M.ezr().alias("score"))
    diffs = slices(T.paired(scores, FOCAL)).select("query_id", "engine", "slice", "diff")
    cell = ["engine", "slice"]
    tests = kept(spark, "ezr-tests", f"{d}/{replicates}", lambda: T.interval(T.bootstrap(diffs, cell, replicates), cell))  # all queries over the tests share them
    return diffs, tests


@query
def st4_ezr_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    _, tests = ezr_tests(spark, d)
    return tests.select("engine", "slice", *[F.round(c, 9).alias(c) for c in ("ci_low", "ci_high", "p_raw")], "n_replicates")


@query
def w05_holm(spark: SparkSession, d: str) -> DataFrame:
    """EZR tests, adjusted over the whole family; within noise unless significant and away from 0."""
    diffs, tests = ezr_tests(spark, d)
    out = T.holm(tests, [], ["engine", "slice"])
    noise = ~F.col("significant") | ((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0))
    return out.select("engine", "slice", F.round("p_raw", 9).alias("p_raw"), F.round("p_holm", 9).alias("p_holm"), "significant", noise.alias("within_noise"))


@query
def t02_narrow_margins(spark: SparkSession, d: str) -> DataFrame:
    """The eight tests with the smallest differences among those that are significant."""
    diffs, tests = ezr_tests(spark, d)
    mean = diffs.groupBy("engine", "slice").agg((F.sum("diff") / F.count("*")).alias("diff"))
    return T.holm(tests, [], ["engine", "slice"]).filter("significant").join(mean, ["engine", "slice"]).orderBy(F.abs(F.round("diff", 9)), "engine", "slice").limit(8).select("engine", "slice", F.round("diff", 9).alias("diff"))


@query
def w07_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of the engines' scores under two label sets, per sector."""
    hits = two_sets(spark, d)
    per = hits.groupBy("sector", "engine").agg((F.sum("gain_code") / F.count("*")).alias("x"), (F.sum(A.gain_of(F.col("label_b"))) / F.count("*")).alias("y"))
    ranked = T.average_ranks(T.average_ranks(per, ["sector"], "x", "rx"), ["sector"], "y", "ry")
    return ranked.groupBy("sector").agg(F.round(F.corr("rx", "ry"), 9).alias("rho"))


@query
def w08_engine_order(spark: SparkSession, d: str) -> DataFrame:
    """Engines from best to worst by nDCG@10 of each sector."""
    per = M.query_engine(spark, d).groupBy("sector", "engine").agg(M.mean(M.ndcg(10)).alias("s"))
    return per.groupBy("sector").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("k"), "engine"))), lambda e: e["engine"]), " > ").alias("ordering"))


@query
def a31_sector_heat(spark: SparkSession, d: str) -> DataFrame:
    rows = M.query_engine(spark, d).withColumn("ezr", M.ezr())
    wide = rows.groupBy("sector").pivot("engine", list(ENGINES)).agg(F.round(F.avg("ezr"), 9))
    return wide


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Documents as products: the source as title, the text as description."""
    return table(spark, d, "documents").select("doc_id", product_text(F.col("source"), F.coalesce("text", F.lit(""))).alias("text"))


def index(spark: SparkSession, d: str) -> Index:
    """The catalogue's index, made once in a session."""
    return build(spark, catalogue(spark, d), d)


def searches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query
def a39_bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    """Of each term its documents, occurrences and idf, with the corpus figures."""
    own = index(spark, d)
    return own.terms.select("term", "df", "cf", F.lit(own.n_docs).cast("long").alias("n_docs"), F.round(F.lit(own.avgdl), 6).alias("avgdl"), F.round(idf(F.col("df"), F.lit(own.n_docs)), 9).alias("idf"))


@query
def t01_bm25_top30(spark: SparkSession, d: str) -> DataFrame:
    return search(spark, index(spark, d), searches(spark, d)).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query
def t01_bm25_by_join(spark: SparkSession, d: str) -> DataFrame:
    """The same by a join of terms and postings, without an index."""
    return bm25(catalogue(spark, d), searches(spark, d)).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query
def p01_norm_id(spark: SparkSession, d: str) -> DataFrame:
    return judged_hit(spark, d).select("raw_id", S.norm_id(F.col("raw_id")).alias("norm_id")).distinct()


def price_text(k: Column, p: Column) -> Column:
    shown = p.cast("decimal(12,2)").cast("string")
    forms = [F.concat(F.lit("$1,"), shown), F.concat(shown, F.lit(" - 20.00")), F.lit("n/a"), F.lit(""), F.concat(F.lit("-"), shown), F.concat(F.lit("Rs. "), shown), F.lit("1.2.3"), shown]
    return F.element_at(F.array(*forms), (k % 8 + 1).cast("int"))


@query
def p06_clean_price(spark: SparkSession, d: str) -> DataFrame:
    raw = price_text(F.col("p_partkey"), F.col("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", S.clean_price(raw).alias("price"), S.to_float(raw).alias("plain"), S.extract_number(raw).alias("first_number"))


@query
def p13_strip_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", S.strip_html(F.col("html")).alias("text"), S.url_tail(F.col("url")).alias("tail"), S.is_http_url(F.col("url")).alias("is_http"))


@query
def p24_category_pick(spark: SparkSession, d: str) -> DataFrame:
    sep = F.when(F.col("p_partkey") % 2 == 0, " > ").otherwise(">>")
    full = F.concat("p_brand", sep, "p_type", sep, "p_name")
    return table(spark, d, "part").select("p_partkey", S.category_pick(full).alias("leaf"), S.category_pick(full, False).alias("top"), S.path(F.array("p_brand", F.lit("nan"), "p_type")).alias("path"))


@query
def p28_discount(spark: SparkSession, d: str) -> DataFrame:
    discounted = F.when(F.col("l_discount") > 0, F.col("l_extendedprice") * (1 - F.col("l_discount")))
    pct = S.discount_percent(F.col("l_extendedprice"), discounted)
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(F.avg(pct), 6).alias("mean_percent"), F.count(pct).alias("n"))


@query
def p41_word_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of each query's words by its best documents."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("doc_text"))
    found = t01_bm25_top30(spark, d).filter("rank <= 3").join(docs, "doc_id")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    cover = F.round(S.word_coverage(S.tokens(F.col("text")), S.tokens(F.col("doc_text"))), 9)
    return found.join(q, "query_id").select("query_id", "doc_id", cover.alias("coverage"))


@query
def g05_norm_invariance(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each query and engine, with ids normalised beforehand and not: rows that differ."""
    hits = judged_hit(spark, d)
    spelled = hits.withColumn("norm_id", S.norm_id(F.upper(F.concat(F.substring("norm_id", 1, 2), F.lit("-"), F.substring("norm_id", 3, 9)))))
    cols = ["query_id", "engine", "dcg10", "idcg10", "exact10", "n_exact", "junk10"]
    a, b = (M.query_engine(spark, d, h).select(*cols) for h in (hits, spelled))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("n_differ"))
