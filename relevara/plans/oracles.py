"""The named queries as SQL for DuckDB, written apart from the DataFrame plans."""

from __future__ import annotations

import math

from relevara.functions.scalars import STOP_WORDS

_DISC = ", ".join(str(round(1e12 / math.log2(i + 2))) for i in range(20))


def _mixed(numbers: str) -> str:
    """A list of 32-bit numbers, mixed as the bootstrap's draws are."""
    for shift, factor in ((16, 2146121005), (15, 830770091), (14, 739982445)):
        numbers = f"list_transform({numbers}, lambda h: (xor(h, h >> {shift}) * {factor}) & 4294967295)"
    return f"list_transform({numbers}, lambda h: xor(h, h >> 16))"


_HIT = f"""
WITH RECURSIVE qs AS (
  SELECT c_custkey AS query_id, c_mktsegment AS sector, ['simple','medium','complex'][c_nationkey % 3 + 1] AS tier FROM customer
), found AS (
  SELECT o_custkey AS query_id, l_suppkey % 5 AS e, l_partkey % 60 AS p, min(l_shipdate) AS d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, e ORDER BY d, p) AS INTEGER) AS rank FROM found),
hit AS (
  SELECT query_id, sector, tier, ['focal','rival_a','rival_b','rival_c','rival_d'][e + 1] AS engine, rank, p,
    CASE WHEN e = 0 THEN 'P-00-' ELSE 'p00' END || lpad(CAST(p AS VARCHAR), 2, '0') AS raw_id, 'p00' || lpad(CAST(p AS VARCHAR), 2, '0') AS norm_id,
    CAST(CASE WHEN query_id % 12 = 0 THEN 0 WHEN h < 40 THEN (CASE WHEN query_id % 12 = 1 THEN 10 ELSE 100 END) WHEN h < 55 THEN 10 WHEN h < 65 THEN 1 ELSE 0 END AS INTEGER) AS gain_code
  FROM (SELECT *, (query_id * 7919 + p * 104729) % 100 AS h FROM ranked WHERE rank <= 20) JOIN qs USING (query_id)
  WHERE NOT (e = 4 AND tier = 'complex' AND query_id % 10 < 6)
), labelled AS (
  SELECT *, CASE gain_code WHEN 100 THEN 'Exact' WHEN 10 THEN 'Substitute' WHEN 1 THEN 'Complementary' ELSE 'Irrelevant' END AS label FROM hit
), two AS (
  SELECT *, CASE WHEN (query_id * 31 + p * 17) % 100 < 12 THEN (CASE label WHEN 'Exact' THEN 'Substitute' WHEN 'Substitute' THEN 'Complementary' WHEN 'Complementary' THEN 'Irrelevant' ELSE 'Exact' END) ELSE label END AS label_b FROM labelled
), both2 AS (SELECT *, CASE label_b WHEN 'Exact' THEN 100 WHEN 'Substitute' THEN 10 WHEN 'Complementary' THEN 1 ELSE 0 END AS gain_b FROM two),
disc AS (SELECT [{_DISC}] AS d),
grid AS (SELECT qs.*, engine FROM qs, (SELECT unnest(['focal','rival_a','rival_b','rival_c','rival_d']) AS engine))
"""


def _metrics(source: str, gain: str, tag: str = "") -> str:
    """CTEs pool, ideal, exact and qe over the hits of ``source``."""
    return f"""
, pool{tag} AS (SELECT query_id, norm_id, max({gain}) AS gain_code FROM {source} GROUP BY ALL),
ideal{tag} AS (
  SELECT query_id, CAST(sum(CASE WHEN r <= 10 THEN gain_code * d[r] ELSE 0 END) AS BIGINT) AS idcg10, CAST(sum(CASE WHEN r <= 20 THEN gain_code * d[r] ELSE 0 END) AS BIGINT) AS idcg20
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain_code DESC, norm_id) AS r FROM pool{tag}), disc WHERE r <= 20 GROUP BY query_id
), exact{tag} AS (SELECT query_id, count(DISTINCT norm_id) AS n_exact FROM {source} WHERE {gain} = 100 GROUP BY query_id),
own{tag} AS (
  SELECT query_id, engine, count(*) AS n_hits, max({gain}) AS best, count(*) FILTER ({gain} = 100) AS nrel,
    CAST(coalesce(sum({gain} * d[rank]) FILTER (rank <= 10), 0) AS BIGINT) AS dcg10, CAST(sum({gain} * d[rank]) AS BIGINT) AS dcg20,
    count(*) FILTER (rank <= 10) AS n10, count(*) AS n20, CAST(coalesce(sum({gain}) FILTER (rank <= 10), 0) AS BIGINT) AS g10, CAST(sum({gain}) AS BIGINT) AS g20,
    count(*) FILTER (rank <= 10 AND {gain} = 0) AS j10, count(*) FILTER ({gain} = 0) AS j20,
    count(DISTINCT norm_id) FILTER (rank <= 10 AND {gain} = 100) AS e10, count(DISTINCT norm_id) FILTER ({gain} = 100) AS e20
  FROM {source}, disc GROUP BY ALL
), qe{tag} AS (
  SELECT g.query_id, g.engine, g.sector, g.tier, coalesce(n_hits, 0) AS n_hits, coalesce(nrel, 0) AS nrel, coalesce(best, 0) = 0 AS ezr, coalesce(n_hits, 0) = 0 AS zero, n_hits > 0 AND best = 0 AS junk_only,
    CASE WHEN idcg10 > 0 THEN coalesce(dcg10, 0) / idcg10 END AS ndcg10, CASE WHEN idcg20 > 0 THEN coalesce(dcg20, 0) / idcg20 END AS ndcg20,
    coalesce((200 * g10 + n10) // (2 * n10) / 10000.0::DOUBLE, 0.0::DOUBLE) AS p10, coalesce((200 * g20 + n20) // (2 * n20) / 10000.0::DOUBLE, 0.0::DOUBLE) AS p20,
    CASE WHEN n_exact > 0 THEN coalesce(e10, 0) / n_exact END AS recall10, CASE WHEN n_exact > 0 THEN coalesce(e20, 0) / n_exact END AS recall20, j10 / n10 AS junk10, j20 / n20 AS junk20, coalesce(n_exact, 0) AS n_exact, coalesce(idcg10, 0) AS idcg10
  FROM grid g LEFT JOIN own{tag} o ON o.query_id = g.query_id AND o.engine = g.engine LEFT JOIN ideal{tag} i ON i.query_id = g.query_id LEFT JOIN exact{tag} x ON x.query_id = g.query_id
)"""


_QE = _HIT + _metrics("hit", "gain_code")
_AGG = _QE + """, sums AS (SELECT engine, sector, tier, CAST(sum(CAST(zero AS INT)) AS BIGINT) AS z, CAST(sum(CAST(round(p10 * 10000) AS BIGINT)) AS BIGINT) AS s10, CAST(sum(CAST(round(p20 * 10000) AS BIGINT)) AS BIGINT) AS s20, count(*) AS n_queries FROM qe GROUP BY ALL),
agg AS (SELECT engine, sector, tier, (20000 * z + n_queries) // (2 * n_queries) / 100.0::DOUBLE AS zero_pct, (20000 * s10 + n_queries * 10000) // (20000 * n_queries) / 100.0::DOUBLE AS p10_pct, (20000 * s20 + n_queries * 10000) // (20000 * n_queries) / 100.0::DOUBLE AS p20_pct, n_queries FROM sums)"""
_COLL = _HIT + """, lab AS (SELECT query_id, sector, norm_id, raw_id, min(CASE WHEN engine = 'focal' THEN label_b ELSE label END) AS label FROM two GROUP BY ALL),
pairs AS (SELECT a.query_id, a.sector, a.norm_id, a.raw_id AS raw_a, b.raw_id AS raw_b, a.label AS label_a, b.label AS label_b FROM lab a JOIN lab b ON a.query_id = b.query_id AND a.norm_id = b.norm_id AND a.raw_id < b.raw_id)"""
_BOOT = _QE + """, diffs AS (
  SELECT r.query_id, r.engine, s.slice, CAST(f.ezr AS INT) - CAST(r.ezr AS INT) AS diff
  FROM qe r JOIN qe f ON f.query_id = r.query_id AND f.engine = 'focal' AND r.engine <> 'focal', LATERAL (SELECT unnest(['overall', r.sector, r.tier]) AS slice) s
), cells AS (SELECT engine, slice, list(diff ORDER BY diff) AS v, count(*) AS n, row_number() OVER (ORDER BY engine, slice) AS c FROM diffs GROUP BY engine, slice),
reps AS (SELECT engine, slice, v, n, rep, """ + _mixed("[(" + _mixed("[42 * 65536 + c]") + "[1] + rep) & 4294967295]") + """[1] AS k FROM cells, range(10000) t(rep)),
boot AS (SELECT engine, slice, rep, list_sum(list_transform(""" + _mixed("list_transform(range(n), lambda draw: (k + draw * 506952113) & 4294967295)") + """, lambda h: v[h % n + 1])) / n AS m FROM reps),
tests AS (SELECT engine, slice, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high, least(1.0::DOUBLE, 2 * least(avg(CAST(m <= 0 AS INT)), avg(CAST(m >= 0 AS INT)))) AS p_raw, count(*) AS n_replicates FROM boot GROUP BY ALL),
steps AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p_raw, engine, slice) + 1) * p_raw AS step FROM tests),
holm AS (SELECT *, least(1.0::DOUBLE, max(step) OVER (ORDER BY p_raw, engine, slice ROWS UNBOUNDED PRECEDING)) AS p_holm FROM steps)"""
_STOP = "list_filter(string_split('" + " ".join(STOP_WORDS) + "', ' '), lambda w: true)"
_TOK = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains(" + _STOP + ", t))"
_TITLED = "(source || ' ' || source || ' ' || source || ' ' || coalesce(text, ''))"
_BM = f"""
WITH words AS (SELECT doc_id, {_TOK.format(_TITLED)} AS t FROM documents),
stats AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM words),
post AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM words), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM post GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK.format('text')}) AS term FROM benchmark),
sc AS (
  SELECT query_id, doc_id, sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) ORDER BY term) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term), stats GROUP BY ALL
), top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 30)"""
_PROD = """WITH products AS (
  SELECT lower(p_brand) || ':' || p_partkey AS product_id, CASE WHEN p_partkey % 11 = 0 THEN ' N/A ' ELSE p_name END AS title,
    CASE WHEN p_partkey % 5 = 0 THEN 'nan' ELSE p_brand END AS brand, p_type AS category, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS price
  FROM part
)"""
_OK = "CASE WHEN lower(trim({0})) IN ('', 'nan', 'none', 'null', 'n/a', 'na', '<na>') THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END"
_M9 = ", ".join(f"round(avg({c}), 9) AS {c}" for c in ("ndcg10", "ndcg20", "p10", "p20", "recall10", "recall20"))
_ALL = _M9 + ", round(avg(CAST(ezr AS INT)), 9) AS ezr, round(avg(CAST(zero AS INT)), 9) AS zero_rate, round(avg(CAST(coalesce(junk_only, false) AS INT)), 9) AS all_junk, round(avg(junk10), 9) AS junk10, round(avg(junk20), 9) AS junk20, round(avg(nrel), 9) AS nrel"
_KAPPA = _HIT + """, j AS (SELECT {by} label, label_b, count(*) AS c FROM two GROUP BY ALL),
s AS (SELECT {by} sum(c) AS n, sum(CASE WHEN label = label_b THEN c ELSE 0 END) AS same FROM j GROUP BY ALL),
a AS (SELECT {by} label AS l, sum(c) AS na FROM j GROUP BY ALL), b AS (SELECT {by} label_b AS l, sum(c) AS nb FROM j GROUP BY ALL),
x AS (SELECT {by} sum(na * nb) AS cr FROM a JOIN b USING ({by} l) GROUP BY ALL)
SELECT {by} CAST(n AS BIGINT) AS n, round(same / n, 9) AS agreement, round((same / n - cr / (n * n)) / (1 - cr / (n * n)), 9) AS kappa FROM s {join}"""

ORACLE_SQL: dict[str, str] = {
    "s03_flattened": _HIT + "SELECT query_id, sector, tier, engine, rank, raw_id, label FROM labelled",
    "a01_pool_max_gain": _QE + "SELECT query_id, norm_id, gain_code FROM pool",
    "a02_idcg": _QE + "SELECT * FROM ideal",
    "a03_pooled_ndcg": _QE + "SELECT engine, count(*) AS n, round(avg(ndcg10), 9) AS ndcg10, round(avg(ndcg20), 9) AS ndcg20 FROM qe WHERE idcg10 > 0 GROUP BY engine",
    "a04_self_ndcg": _HIT
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, engine ORDER BY gain_code DESC, norm_id) AS i FROM hit WHERE rank <= 10),
s AS (SELECT query_id, engine, sum(gain_code * d[rank]) AS dcg, sum(gain_code * d[i]) AS best FROM r, disc GROUP BY ALL)
SELECT g.engine, round(avg(CASE WHEN best > 0 THEN CAST(dcg AS BIGINT) / CAST(best AS BIGINT) ELSE 0 END), 9) AS self_ndcg10, count(*) AS n FROM grid g LEFT JOIN s ON s.query_id = g.query_id AND s.engine = g.engine GROUP BY g.engine""",
    "a05_graded_precision": _QE + "SELECT query_id, engine, p10, p20 FROM qe",
    "a06_pooled_recall": _QE + "SELECT query_id, engine, recall10, recall20 FROM qe WHERE n_exact > 0",
    "a07_ezr_disjoint": _QE
    + "SELECT engine, count(*) FILTER (ezr) AS n_ezr, count(*) FILTER (zero) AS n_zero, count(*) FILTER (junk_only) AS n_junk, count(*) AS n, count(*) FILTER (ezr) = count(*) FILTER (zero) + count(*) FILTER (junk_only) AS holds FROM qe GROUP BY engine",
    "a08_cells": _QE + f"SELECT engine, coalesce(sector, tier, 'overall') AS slice, count(*) AS n, {_ALL} FROM qe GROUP BY GROUPING SETS ((engine), (engine, sector), (engine, tier))",
    "a14_recall_by_tier": _QE
    + "SELECT engine, 10 AS k, tier, round(avg(recall10), 9) AS rate, count(*) AS n FROM qe WHERE n_exact > 0 GROUP BY ALL UNION ALL SELECT engine, 20, tier, round(avg(recall20), 9), count(*) FROM qe WHERE n_exact > 0 GROUP BY ALL",
    "a15_aggregates": _AGG + "SELECT * FROM agg",
    "a16_recombined": _AGG
    + "SELECT engine, round(sum(zero_pct * n_queries) / sum(n_queries), 6) AS zero_pct, round(sum(p10_pct * n_queries) / sum(n_queries), 6) AS p10_pct, round(sum(p20_pct * n_queries) / sum(n_queries), 6) AS p20_pct, CAST(sum(n_queries) AS BIGINT) AS n_queries FROM agg GROUP BY engine",
    "a17_label_census": _HIT + "SELECT label, count(*) AS n FROM labelled GROUP BY label",
    "a18_populations": _QE
    + "SELECT sector, tier, count(*) AS n_all, count(*) FILTER (idcg10 > 0) AS n_ndcg, count(*) FILTER (n_exact > 0) AS n_recall, count(*) FILTER (idcg10 > 0 AND n_exact = 0) AS n_between FROM qe WHERE engine = 'focal' GROUP BY ALL",
    "a19_median_fill": """WITH p AS (SELECT p_partkey, p_type, CAST(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE round(p_retailprice * 100) END AS BIGINT) AS cents FROM part),
m AS (SELECT p_type, CAST(floor(median(cents) + 0.5::DOUBLE) AS BIGINT) AS m FROM p WHERE cents > 0 GROUP BY p_type)
SELECT p_partkey, CASE WHEN cents = 0 THEN coalesce(m, (SELECT CAST(floor(median(cents) + 0.5::DOUBLE) AS BIGINT) FROM p WHERE cents > 0)) ELSE cents END / 100 AS price FROM p LEFT JOIN m USING (p_type)""",
    "a20_completeness": _PROD + " " + " UNION ALL ".join(f"SELECT '{c}' AS field, round(avg({_OK.format(c)}), 1) AS pct FROM products" for c in ("product_id", "title", "brand", "category")) + " UNION ALL SELECT 'price', round(100 * count(price) / count(*), 1) FROM products",
    "a21_count_gate": "SELECT name, n, expected, n = expected AS passes FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, CAST(round((SELECT count(*) FROM customer) * {f}) AS BIGINT) AS expected FROM {t}" for t, f in (("part", "200 / 150"), ("orders", "10"), ("lineitem", "40"))) + ")",
    "a22_mapping_counters": _PROD + " SELECT count(*) FILTER (title = ' N/A ') AS skipped, count(*) - count(DISTINCT CASE WHEN title = ' N/A ' THEN '' ELSE trim(title) END) AS duplicate_titles, count(*) FILTER (price IS NULL) AS price_defaulted FROM products",
    "a23_id_mode": _PROD + " SELECT CASE WHEN bool_and(regexp_matches(split_part(product_id, ':', 2), '^-*[0-9]+$')) THEN 'int' ELSE 'str' END AS raw_mode, CASE WHEN bool_and(regexp_matches(product_id, '^-*[0-9]+$')) THEN 'int' ELSE 'str' END AS product_mode FROM products",
    "a24_confusion": _HIT + "SELECT label, " + ", ".join(f"count(*) FILTER (label_b = '{x}') AS \"{x}\"" for x in ("Exact", "Substitute", "Complementary", "Irrelevant")) + " FROM two GROUP BY label",
    "a25_kappa": _KAPPA.format(by="", join=", x"),
    "a26_gain_delta": _HIT + "SELECT round(sum(gain_b - gain_code) / (count(*) * 100), 9) AS mean_delta, round(sum(abs(gain_b - gain_code)) / (count(*) * 100), 9) AS mean_abs_delta FROM both2",
    "a27_agreement_by_sector": _KAPPA.format(by="sector,", join="JOIN x USING (sector)"),
    "a28_metrics_by_label_set": _HIT
    + _metrics("both2", "gain_code")
    + _metrics("both2", "gain_b", "_b")
    + " UNION ALL ".join(f" SELECT '{n}' AS label_set, engine, round(avg(ndcg10), 9) AS ndcg10, round(avg(p10), 9) AS p10, round(avg(recall10), 9) AS recall10, round(avg(CAST(ezr AS INT)), 9) AS ezr FROM {t} GROUP BY engine" for n, t in (("a", "qe"), ("b", "qe_b"))),
    "a31_sector_heat": _QE + "SELECT sector, " + ", ".join(f"round(avg(CAST(ezr AS INT)) FILTER (engine = '{e}'), 9) AS {e}" for e in ("focal", "rival_a", "rival_b", "rival_c", "rival_d")) + " FROM qe GROUP BY sector",
    "j08_collisions": _COLL + "SELECT query_id, norm_id, raw_a, raw_b, label_a, label_b FROM pairs",
    "a36_collision_summary": _COLL + "SELECT sector, count(DISTINCT query_id) AS n_queries, count(*) AS n_pairs, count(*) FILTER (label_a = label_b) AS n_agree FROM pairs GROUP BY sector",
    "a37_canonical_gain": _HIT
    + ", g AS (SELECT *, CASE WHEN engine = 'focal' THEN gain_b ELSE gain_code END AS g, row_number() OVER (PARTITION BY query_id, norm_id ORDER BY engine, rank) AS rn FROM both2) SELECT query_id, norm_id, max(g) AS by_max, min(g) AS by_min, max(g) FILTER (rn = 1) AS by_engine FROM g GROUP BY ALL",
    "a38_integrity": _HIT
    + "SELECT (SELECT count(*) FROM (SELECT 1 FROM hit GROUP BY query_id, engine, norm_id HAVING count(*) > 1)) AS duplicates, (SELECT count(*) FROM (SELECT 1 FROM hit GROUP BY query_id, norm_id HAVING count(DISTINCT gain_code) > 1)) AS inconsistent, 0::BIGINT AS not_in_pool",
    "j05_paired_diffs": _QE
    + "SELECT r.engine, CAST(sum(CAST(f.ezr AS INT) - CAST(r.ezr AS INT)) AS BIGINT) AS total, count(*) FILTER (r.ezr AND NOT f.ezr) AS wins, count(*) FILTER (f.ezr AND NOT r.ezr) AS losses, count(*) AS n FROM qe r JOIN qe f ON f.query_id = r.query_id AND f.engine = 'focal' WHERE r.engine <> 'focal' GROUP BY r.engine",
    "j09_to_judge": _HIT + "SELECT DISTINCT query_id, raw_id FROM hit WHERE query_id % 3 <> 0",
    "j10_provider_merge": _HIT
    + "SELECT query_id, engine, count(*) + CASE WHEN engine = 'focal' THEN 100 ELSE 0 END AS n FROM hit WHERE query_id % 2 = 0 OR engine = 'focal' GROUP BY query_id, engine",
    "w04_first_seen": _HIT + "SELECT query_id, norm_id, engine, rank FROM hit QUALIFY row_number() OVER (PARTITION BY query_id, norm_id ORDER BY engine, rank) = 1",
    "w09_last_wins": "SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) = 1",
    "w12_stratified_sample": _HIT + "SELECT sector, tier, query_id FROM qs QUALIFY row_number() OVER (PARTITION BY sector, tier ORDER BY (query_id * 7919 + 42 * 104729) % 15485863, query_id) <= 6",
    "st4_ezr_bootstrap": _BOOT + "SELECT engine, slice, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, round(p_raw, 9) AS p_raw, n_replicates FROM tests",
    "w05_holm": _BOOT + "SELECT engine, slice, round(p_raw, 9) AS p_raw, round(p_holm, 9) AS p_holm, p_holm < 0.05 AS significant, p_holm >= 0.05 OR (ci_low <= 0 AND ci_high >= 0) AS within_noise FROM holm",
    "t02_narrow_margins": _BOOT
    + ", mean AS (SELECT engine, slice, sum(diff) / count(*) AS diff FROM diffs GROUP BY ALL) SELECT engine, slice, round(diff, 9) AS diff FROM holm JOIN mean USING (engine, slice) WHERE p_holm < 0.05 ORDER BY abs(round(diff, 9)), engine, slice LIMIT 8",
    "w07_spearman": _HIT
    + """, per AS (SELECT sector, engine, sum(gain_code) / count(*) AS x, sum(gain_b) / count(*) AS y FROM both2 GROUP BY ALL),
r AS (SELECT sector, rank() OVER (PARTITION BY sector ORDER BY x) + (count(*) OVER (PARTITION BY sector, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY sector ORDER BY y) + (count(*) OVER (PARTITION BY sector, y) - 1) / 2 AS ry FROM per)
SELECT sector, round(corr(rx, ry), 9) AS rho FROM r GROUP BY sector""",
    "w08_engine_order": _QE + ", per AS (SELECT sector, engine, round(avg(ndcg10), 9) AS s FROM qe GROUP BY ALL) SELECT sector, string_agg(engine, ' > ' ORDER BY s DESC, engine) AS ordering FROM per GROUP BY sector",
    "a39_bm25_stats": _BM + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, n_docs, round(avgdl, 6) AS avgdl, round(ln(1 + (n_docs - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 9) AS idf FROM tf, stats GROUP BY term, n_docs, avgdl",
    "t01_bm25_by_join": _BM + "SELECT query_id, doc_id, rank, round(score, 6) AS score FROM top",
    "t01_bm25_top30": _BM + "SELECT query_id, doc_id, rank, round(score, 6) AS score FROM top",
    "p01_norm_id": _HIT + "SELECT DISTINCT raw_id, replace(lower(raw_id), '-', '') AS norm_id FROM hit",
    "p06_clean_price": """WITH r AS (SELECT p_partkey, p_partkey % 8 AS k, CAST(p_retailprice AS DECIMAL(12,2)) AS p FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN CAST('1' || p AS DOUBLE) WHEN 1 THEN CAST(p AS DOUBLE) WHEN 4 THEN CAST(p AS DOUBLE) WHEN 5 THEN CAST(p AS DOUBLE) WHEN 7 THEN CAST(p AS DOUBLE) END AS price,
  CASE k WHEN 7 THEN CAST(p AS DOUBLE) END AS plain,
  CASE k WHEN 0 THEN 1.0::DOUBLE WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 6 THEN 1.2::DOUBLE ELSE CAST(p AS DOUBLE) END AS first_number FROM r""",
    "p13_strip_html": r"""SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS text, regexp_extract(url, '([^/]+)/*$', 1) AS tail, regexp_matches(lower(trim(url)), '^https?://') AS is_http FROM pages""",
    "p24_category_pick": "SELECT p_partkey, trim(p_name) AS leaf, trim(p_brand) AS top, trim(p_brand) || ' > ' || trim(p_type) AS path FROM part",
    "p28_discount": "SELECT l_partkey, round(avg(CASE WHEN l_discount > 0 AND l_extendedprice > 0 THEN round((l_extendedprice - l_extendedprice * (1 - l_discount)) / l_extendedprice * 100, 2) END), 6) AS mean_percent, count(*) FILTER (l_discount > 0 AND l_extendedprice > 0) AS n FROM lineitem GROUP BY l_partkey",
    "p41_word_coverage": _BM
    + f" SELECT query_id, doc_id, round(len(list_filter(list_distinct({_TOK.format('b.text')}), lambda t: list_contains({_TOK.format('d.text')}, t))) / len(list_distinct({_TOK.format('b.text')})), 9) AS coverage FROM top JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 3",
    "g05_norm_invariance": "SELECT 0::BIGINT AS n_differ",
}
