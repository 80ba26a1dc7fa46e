"""Named queries over catalogues: cleaning, attributes, prices, uploads; each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relevara.functions import catalog as C
from relevara.functions.trees import pruned_trees
from relevara.functions import responses as R
from relevara.functions import scalars as S
from relevara.operators.judged import TIERS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


def key() -> Column:
    return F.col("p_partkey")


def choose(*forms: Column | str | None) -> Column:
    """One of the forms by the part's number."""
    out = F.lit(None).cast("string")
    for i, x in enumerate(forms):
        out = F.when(key() % len(forms) == i, x if isinstance(x, Column) else F.lit(x)).otherwise(out)
    return out


@query("SELECT p_partkey, concat_ws(' ', CASE WHEN p_partkey % 4 <> 0 THEN p_brand END, p_type) AS listed, '{\"brand\": \"' || p_brand || '\", \"type\": \"' || p_type || '\"}' AS mapped FROM part")
def p04_clean_nested(spark: SparkSession, d: str) -> DataFrame:
    """Lists join their non-empty parts, maps become JSON with sorted keys."""
    listed = F.array(F.when(key() % 4 == 0, " N/A ").otherwise(F.col("p_brand")), F.lit("nan"), F.lit(None), F.concat(F.lit(" "), "p_type"))
    mapped = F.create_map(F.lit("type"), "p_type", F.lit("none"), F.lit(None), F.lit("brand"), "p_brand", F.lit("empty"), F.lit(""))
    return table(spark, d, "part").select("p_partkey", C.clean_list(listed).alias("listed"), C.sorted_json(mapped).alias("mapped"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN p_brand ELSE '' END AS cleaned FROM part")
def p05_clean_upload(spark: SparkSession, d: str) -> DataFrame:
    raw = choose(F.lit(" NaN "), F.lit(" n/a "), F.concat(F.lit(" "), "p_brand"), F.lit(None).cast("string"))
    return table(spark, d, "part").select("p_partkey", S.clean_text_upload(raw).alias("cleaned"))


@query("SELECT l_linenumber AS n, count(*) AS k, CAST(sum(CASE l_linenumber % 5 WHEN 0 THEN 0 WHEN 1 THEN 100 WHEN 2 THEN 10 WHEN 3 THEN 1 ELSE 1 END) AS BIGINT) AS gain FROM lineitem GROUP BY ALL")
def p02_label_gain(spark: SparkSession, d: str) -> DataFrame:
    """Labels in any case and spelling to gains; an unknown one is an error."""
    forms = ("irrelevant", " EXACT ", "Substitute", "complement", "complementary ")
    label = F.element_at(F.array(*map(F.lit, forms)), F.col("l_linenumber") % 5 + 1)
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("n")).agg(F.count("*").alias("k"), F.sum(S.gain_code(label)).alias("gain"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Exact' WHEN 1 THEN 'Complementary' WHEN 2 THEN NULL WHEN 3 THEN 'Irrelevant' END AS label FROM part")
def p03_canonical_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.canonical_label(choose(F.lit("eXACT"), F.lit(" complement"), F.lit("Exact match"), F.lit("IRRELEVANT"), F.lit(None).cast("string"))).alias("label"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'N/A' ELSE printf('%.2f', p_retailprice) END AS price, left(repeat(p_name || ' ', 200), 1500) AS description, floor(p_retailprice * 100) / 100 AS cut FROM part")
def p09_price_text(spark: SparkSession, d: str) -> DataFrame:
    price = F.when(key() % 6 != 0, F.col("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", C.price_text(price).alias("price"), C.short_description(F.repeat(F.concat("p_name", F.lit(" ")), F.lit(200))).alias("description"), S.truncated(F.col("p_retailprice")).alias("cut"))


@query(
    "SELECT CAST(p_partkey AS VARCHAR) AS id, trim(p_name) AS title, CASE WHEN p_partkey % 3 = 0 THEN 'v' ELSE p_brand END AS brand, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'http://i/' || p_partkey END AS image,"
    " CASE WHEN p_partkey % 2 = 0 THEN p_retailprice + 10 ELSE p_retailprice END AS price, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS discount_price FROM part"
)
def p10_vendor_hit(spark: SparkSession, d: str) -> DataFrame:
    payload = F.struct(
        key().alias("id"),
        F.concat(F.lit(" "), "p_name").alias("title"),
        F.when(key() % 3 == 0, "").otherwise(F.col("p_brand")).alias("brand"),
        F.lit("v").alias("vendor"),
        F.when(key() % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("http://i/"), key().cast("string")), F.lit("x"))).alias("images"),
        F.col("p_retailprice").alias("price"),
        F.when(key() % 2 == 0, F.col("p_retailprice") + 10).alias("old_price"),
    )
    return table(spark, d, "part").select(payload.alias("p")).select(C.vendor_hit(F.col("p")).alias("h")).select("h.*")


@query(
    "WITH o AS (SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS r FROM lineitem)"
    " SELECT l_partkey, r AS rank, CAST(l_orderkey AS VARCHAR) AS id, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'line ' || l_linenumber END AS title, l_extendedprice AS price FROM o WHERE r <= 24"
)
def p11_first_24(spark: SparkSession, d: str) -> DataFrame:
    """Vendor lists of a part's lines, normalised and cut."""
    hit = F.struct("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    raw = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_list(hit)).alias("found"))
    title = lambda h: F.when(h["l_linenumber"] % 2 == 1, F.concat(F.lit(" line "), h["l_linenumber"].cast("string"), F.lit(" ")))
    none = F.lit(None).cast("string")
    hits = F.transform("found", lambda h: F.struct(h["l_orderkey"].alias("id"), title(h).alias("title"), none.alias("description"), none.alias("image"), h["price"].alias("price"), F.lit(None).cast("double").alias("discount_price")))
    return raw.select("l_partkey", F.posexplode(C.normalised_hits(hits)).alias("rank", "h")).select("l_partkey", (F.col("rank") + 1).alias("rank"), "h.id", "h.title", "h.price")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN '''' || p_name WHEN 3 THEN '' ELSE p_name || '\"' END AS bare FROM part")
def p14_strip_quotes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    lit = F.lit
    raw = choose(F.concat(lit("'"), n, lit("'")), F.concat(lit("\"' \""), n, lit("\" '\"")), F.concat(lit("'"), n), lit(" '\"\"' "), F.concat(n, lit('"')))
    return table(spark, d, "part").select("p_partkey", C.strip_quotes(raw).alias("bare"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_brand || '|x' WHEN 1 THEN '[broken' WHEN 2 THEN '' WHEN 3 THEN '5' WHEN 4 THEN p_brand ELSE p_brand END AS items, CASE p_partkey % 6 WHEN 0 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS n FROM part")
def p15_json_list(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("p_brand")
    raw = choose(F.concat(F.lit('["'), b, F.lit('", "x"]')), F.lit("[broken"), F.lit(" nan "), F.lit("5"), F.concat(F.lit('"'), b, F.lit('"')), b)
    found = C.json_list(raw)
    return table(spark, d, "part").select("p_partkey", F.array_join(found, "|").alias("items"), F.size(found).alias("n"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN 'maker' WHEN 2 THEN 'store' ELSE 'second' END AS brand FROM part")
def p17_brand(spark: SparkSession, d: str) -> DataFrame:
    known = F.create_map(F.lit("Brand"), choose(F.col("p_brand"), F.lit("nan"), F.lit(""), F.lit(None).cast("string")), F.lit("Manufacturer"), choose(F.lit("maker"), F.lit("maker"), F.lit("n/a"), F.lit("maker")), F.lit("Brand Name"), choose(F.lit(""), F.lit(""), F.lit(""), F.lit("second")))
    return table(spark, d, "part").select("p_partkey", C.brand_of(known, F.lit(" store ")).alias("brand"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'http://h/' || p_partkey WHEN 1 THEN 'http://t' ELSE '' END AS best, CASE p_partkey % 3 WHEN 0 THEN 'http://h/' || p_partkey WHEN 1 THEN 'http://t' ELSE '' END AS best_of_each FROM part")
def p18_best_image(spark: SparkSession, d: str) -> DataFrame:
    hi, large, thumb = choose(F.concat(F.lit("http://h/"), key().cast("string")), F.lit(None).cast("string"), F.lit("")), choose(F.lit("http://l"), F.lit("data:x"), F.lit(None).cast("string")), choose(F.lit("http://t"), F.lit("http://t"), F.lit("ftp://t"))
    lists = F.struct(F.array(F.lit(None).cast("string"), hi).alias("hi_res"), F.array(large).alias("large"), F.array(thumb).alias("thumb"))
    each = F.array(F.struct(F.lit(None).cast("string").alias("hi_res"), F.lit("").alias("large"), F.lit("x").alias("thumb")), F.struct(hi.alias("hi_res"), large.alias("large"), thumb.alias("thumb")))
    return table(spark, d, "part").select("p_partkey", lists.alias("a"), each.alias("b")).select("p_partkey", C.best_image(F.col("a")).alias("best"), C.best_image_of_each(F.col("b")).alias("best_of_each"))


@query(
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN 'Maker ' || p_brand ELSE p_brand END AS maker, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN '(7)' ELSE p_type || ' (a) b' END AS category,"
    " CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'item-' || p_partkey END AS id FROM part"
)
def p19_labels(spark: SparkSession, d: str) -> DataFrame:
    """Makers without label prefixes (P19), categories without counts (P20), ids from addresses or row numbers."""
    b, t, number = F.col("p_brand"), F.col("p_type"), key().cast("string")
    raw = choose(F.concat(F.lit("* Mkt: "), b), F.concat(F.lit("** MFR:manufacturer: "), b), F.concat(F.lit("Maker "), b), F.concat(b, F.lit(" ")))
    category = choose(F.concat(t, F.lit(" (12)")), F.lit("(7)"), F.concat(t, F.lit(" (a) b")))
    url = F.when(key() % 5 == 0, " nan ").otherwise(F.concat(F.lit("http://shop/p/item-"), number, F.lit("//")))
    return table(spark, d, "part").select("p_partkey", C.maker(raw).alias("maker"), C.without_count(category).alias("category"), C.id_of(url, key()).alias("id"))


@query("SELECT p_partkey, '{' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '\"p_brand\": \"' || p_brand || '\", ' END || '\"p_size\": \"' || p_size || '\", \"p_type\": \"' || p_type || '\"}' AS attributes, '{\"a\": {\"b\": [1, \"' || p_brand || '\"]}, \"z\": 2.5}' AS nested FROM part")
def p25_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Columns that no field uses as JSON with sorted keys; nested attributes without empties at any depth."""
    part = table(spark, d, "part").withColumn("p_brand2", F.col("p_brand")).withColumn("p_brand", F.when(key() % 3 != 0, F.col("p_brand")))
    rest = C.leftovers([c for c in part.columns if c != "p_brand2"], ["p_partkey", "p_name", "p_retailprice"])
    nested = F.concat(F.lit('{"z": 2.5, "e": {"f": [null, "", {}]}, "a": {"b": [1, "'), "p_brand2", F.lit('", []], "c": ""}}'))
    trees = pruned_trees(spark, part.select("p_partkey", nested.alias("raw")), "p_partkey", "raw").withColumnRenamed("json", "nested")
    return part.select("p_partkey", C.sorted_json(rest).alias("attributes")).join(trees, "p_partkey")


@query(
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(len(json_keys(props)) AS INT) ELSE 0 END AS n_keys, CASE WHEN event_id % 4 = 0 THEN props ->> '$.k' END AS k FROM events"
)
def p26_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Attributes JSON as a map; empty for null, bad JSON and what is no object."""
    e = F.col("event_id") % 4
    raw = F.when(e == 0, F.col("props")).when(e == 1, "[1, 2]").when(e == 2, '{"k": ')
    return table(spark, d, "events").select("event_id", C.attributes(raw).alias("m")).select("event_id", F.size("m").alias("n_keys"), F.try_element_at("m", F.lit("k")).alias("k"))


@query(
    "WITH p AS (SELECT p_partkey, p_partkey % 6 AS m, p_retailprice AS own FROM part)"
    " SELECT p_partkey, CASE m WHEN 5 THEN 0.0::DOUBLE ELSE own END AS original, CASE m WHEN 0 THEN own / 2 END AS discounted, CASE m WHEN 0 THEN 50.0::DOUBLE END AS percent,"
    " CASE m WHEN 0 THEN own * 2 WHEN 1 THEN 20.0::DOUBLE WHEN 5 THEN 0.0::DOUBLE ELSE own END AS list_original, CASE m WHEN 0 THEN own END AS list_discounted, CASE m WHEN 0 THEN 50.0::DOUBLE END AS list_percent FROM p"
)
def p27_prices(spark: SparkSession, d: str) -> DataFrame:
    """Original price, genuine markdown and percent off in both layouts."""
    own = F.when(key() % 6 != 5, F.col("p_retailprice"))
    text = lambda x: x.cast("string")
    sale = choose(text(F.col("p_retailprice") / 2), text(F.col("p_retailprice") + 1), F.lit("none"), F.lit("-3"), F.lit(""), F.lit(None).cast("string"))
    listed = choose(text(F.col("p_retailprice") * 2), F.lit("list 20.00, now 12 % off"), F.lit("none"), F.lit(None).cast("string"), F.lit(""), F.lit("x"))
    fields = F.create_map(F.lit("discounted_price"), sale, F.lit("list"), listed)
    both = table(spark, d, "part").select("p_partkey", C.prices(text(own), fields).alias("a"), C.prices(text(own), fields, "list").alias("b"))
    return both.select("p_partkey", "a.*", F.col("b.original").alias("list_original"), F.col("b.discounted").alias("list_discounted"), F.col("b.percent").alias("list_percent"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Weave: ' || p_type || ' | ' || p_brand || ' | Size: ' || p_size END AS specs FROM part")
def p29_ruby_specs(spark: SparkSession, d: str) -> DataFrame:
    blob = F.concat(F.lit('{"specs"=>[{"key"=>"Weave", "value"=>" '), "p_type", F.lit('"}, {"value"=>"'), "p_brand", F.lit('"}, {"key"=>"lost"}, {"key" => "Size", "value" => "'), F.col("p_size").cast("string"), F.lit('"}]}'))
    return table(spark, d, "part").select("p_partkey", C.ruby_specs(F.when(key() % 3 == 0, F.col("p_name")).otherwise(blob)).alias("specs"))


FLAGS = "details:asin;rank, features, extra"


@query(
    "SELECT p_partkey, '{\"brand\": \"' || p_brand || '\", \"note\": \"' || p_name || '\", \"size\": \"' || p_size || '\"}' AS metadata, 'size: ' || p_size || ' | type: ' || p_type AS flat, p_name || ' | x' AS listed FROM part"
)
def p30_metadata(spark: SparkSession, d: str) -> DataFrame:
    """In this order: prune, flatten, strip a prefix, drop keys, hoist a nested map without overwriting."""
    flags = C.parse_flags(FLAGS)
    fields = F.create_map(F.lit("brand"), "p_brand", F.lit("extra"), F.lit("dropped"), F.lit("note"), F.concat(F.lit("** Note "), "p_name"))
    details = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.lit("other"), F.lit("asin"), F.lit("B0"), F.lit("empty"), F.lit(""))
    noted = F.map_concat(C.without(fields, ["note"]), F.create_map(F.lit("note"), C.strip_prefix(fields["note"], "Note")))
    whole = C.hoist(C.without(noted, ["extra"]), details, flags["details"])
    typed = F.create_map(F.lit("type"), "p_type", F.lit("size"), F.col("p_size").cast("string"), F.lit("rank"), F.lit("1"))
    listed = C.flatten_list(F.array(F.concat(F.lit(" "), "p_name"), F.lit(""), F.lit(None), F.lit("x")))
    return table(spark, d, "part").select("p_partkey", C.sorted_json(whole).alias("metadata"), C.flatten_map(typed, flags["details"]).alias("flat"), listed.alias("listed"))


@query(
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN -1 WHEN 2 THEN -1 ELSE 1 END AS greedy, CASE p_partkey % 4 WHEN 0 THEN -1 WHEN 1 THEN -1 WHEN 2 THEN 1 ELSE 1 END AS shortest FROM part"
)
def p34_answer_list(spark: SparkSession, d: str) -> DataFrame:
    one, two = '[{"index": 1, "label": "Exact", "reasoning": "as [asked]"}]', '[{"index": 1, "label": "a"},\n{"index": 2, "label": "x ] y"}]'
    raw = choose(F.lit(f"Sure:\n{two} done"), F.lit("no list"), F.lit(one.replace(" [asked]", "") + " and ] more"), F.lit("```" + one.replace(" [asked]", "") + "```"))
    size = lambda x: F.when(x.isNotNull(), F.size(x)).otherwise(-1)
    return table(spark, d, "part").select("p_partkey", size(R.answer_list(raw)).alias("greedy"), size(R.answer_list(raw, False)).alias("shortest"))


@query(
    "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'missing index 2' WHEN 2 THEN 'unknown label at 1' WHEN 3 THEN 'no list' WHEN 4 THEN 'item without index' ELSE 'no reasoning at 2' END AS error, CASE p_partkey % 6 WHEN 0 THEN 'Exact,Complementary' END AS labels FROM part"
)
def p35_validated(spark: SparkSession, d: str) -> DataFrame:
    item = lambda i, label, why="r": f'{{"index": {i}, "label": "{label}", "reasoning": "{why}"}}'
    raw = choose(*[F.lit(x) for x in (f"[{item(2, 'complement')}, {item(1, 'bad')}, {item(1, 'EXACT')}]", f"[{item(1, 'Exact')}]", f"[{item(1, 'Fine')}, {item(2, 'Exact')}]", "nothing", f'[{item(1, "Exact")}, {{"label": "Exact"}}, {item(2, "Exact")}]', f"[{item(1, 'Exact')}, {item(2, 'Exact', ' ')}]")])
    out = R.validated(raw, F.lit(2), rationale=True)
    return table(spark, d, "part").select("p_partkey", out.alias("v")).select("p_partkey", "v.error", F.array_join("v.labels", ",").alias("labels"))


@query(
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 7.5::DOUBLE WHEN 1 THEN 120.0::DOUBLE WHEN 2 THEN 31.0::DOUBLE END AS wait, CASE p_partkey % 5 WHEN 0 THEN 'transient' WHEN 1 THEN 'transient' WHEN 2 THEN 'without_images' WHEN 3 THEN 'transient' END AS kind FROM part"
)
def p36_errors(spark: SparkSession, d: str) -> DataFrame:
    """The wait that an error names (P36) and what kind of error it is (C4)."""
    raw = choose(F.lit("429: Retry-After: 7.5"), F.lit('quota; retry_delay { seconds: 900 }'), F.lit("bad picture, retry-after 31"), F.lit("Connection reset"), F.lit(None).cast("string"))
    return table(spark, d, "part").select("p_partkey", R.retry_seconds(raw).alias("wait"), R.error_class(raw, F.lit(True)).alias("kind"))


@query(
    "WITH s AS (SELECT c_mktsegment AS sector, count(*) AS total FROM customer GROUP BY ALL), t AS (SELECT * FROM s, (VALUES (0, 'simple', 0.5::DOUBLE), (1, 'medium', 0.3::DOUBLE), (2, 'complex', 0.2::DOUBLE)) v(i, tier, share)),"
    " f AS (SELECT *, CAST(floor(total * share) AS BIGINT) AS fl FROM t) SELECT sector, total, tier, fl + CASE WHEN i < total - sum(fl) OVER (PARTITION BY sector) THEN 1 ELSE 0 END AS quota FROM f"
)
def p42_quotas(spark: SparkSession, d: str) -> DataFrame:
    totals = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("sector")).agg(F.count("*").alias("total"))
    return R.quotas(totals, dict(zip(TIERS, (0.5, 0.3, 0.2), strict=True)))


def uploads(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue rows with some ids, titles and pictures missing, and some twice."""
    part = table(spark, d, "part")
    raw = F.when(key() % 17 == 0, "").otherwise((key() - key() % 2 * (key() % 10 == 1).cast("int")).cast("string"))
    return part.select(key().alias("src_row"), S.namespaced(F.lit("s"), raw).alias("product_id"), F.when(key() % 11 == 0, " nan ").otherwise(F.col("p_name")).alias("title"), F.when(key() % 13 != 0, F.col("p_retailprice")).alias("price"), F.when(key() % 7 == 0, "ftp://x").otherwise("HTTPS://i/1").alias("image_url"))


_UPLOADS = """WITH u AS (SELECT p_partkey AS src_row, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE CAST(p_partkey - p_partkey % 2 * CASE WHEN p_partkey % 10 = 1 THEN 1 ELSE 0 END AS VARCHAR) END AS id,
 CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS title, CASE WHEN p_partkey % 13 <> 0 THEN p_retailprice END AS price, p_partkey % 7 = 0 AS bare FROM part),
k AS (SELECT * FROM u WHERE id <> '' AND title <> ''), w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src_row DESC) AS r FROM k)"""


def mapped(rows: DataFrame) -> DataFrame:
    """(id, title, original_price, images) of rows that have an id and a title; of repeated ids the last one."""
    fine = rows.select("src_row", S.last_segment(F.col("product_id")).alias("id"), S.clean_text_upload(F.col("title")).alias("title"), F.coalesce(S.to_float(F.col("price").cast("string")), F.lit(0.0)).alias("original_price"), F.when(S.is_http_url(F.col("image_url")), F.array(F.col("image_url"))).otherwise(F.array().cast("array<string>")).alias("images"))
    kept = fine.filter((F.col("id") != "") & (F.col("title") != ""))
    return kept.groupBy("id").agg(F.max(F.struct("src_row", "title", "original_price", "images")).alias("m")).select("id", "m.title", "m.original_price", "m.images")


@query(_UPLOADS + " SELECT id, title, coalesce(price, 0.0::DOUBLE) AS original_price, CASE WHEN bare THEN 0 ELSE 1 END AS n_images FROM w WHERE r = 1")
def f02_upload_items(spark: SparkSession, d: str) -> DataFrame:
    """Rows without an id or title go, the last of repeated ids stays."""
    return mapped(uploads(spark, d)).select("id", "title", "original_price", F.size("images").alias("n_images"))


@query(_UPLOADS + " SELECT (SELECT count(*) FROM u WHERE id = '' OR title = '') AS skipped, (SELECT count(*) FROM k) - (SELECT count(DISTINCT id) FROM k) AS duplicates, count(*) FILTER (bare) AS no_image, count(*) FILTER (coalesce(price, 0.0::DOUBLE) = 0) AS price_defaulted, count(*) AS items FROM w WHERE r = 1")
def a22_upload_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = uploads(spark, d).select(((S.last_segment(F.col("product_id")) == "") | (S.clean_text_upload(F.col("title")) == "")).alias("bad"))
    seen = rows.agg(F.count("*").alias("seen"), F.count_if("bad").alias("skipped"))
    items = mapped(uploads(spark, d)).agg(F.count_if(F.size("images") == 0).alias("no_image"), F.count_if(F.col("original_price") == 0).alias("price_defaulted"), F.count("*").alias("items"))
    both = seen.join(F.broadcast(items), F.lit(True))
    return both.select("skipped", (F.col("seen") - F.col("skipped") - F.col("items")).alias("duplicates"), "no_image", "price_defaulted", "items")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, CASE WHEN p_partkey % 50 = 3 THEN 9.99::DOUBLE ELSE p_retailprice END AS price FROM part WHERE p_partkey % 11 <> 0 AND p_partkey <> 7")
def f13_corrected(spark: SparkSession, d: str) -> DataFrame:
    """Without rows that lack a title (F1) and a junk record; one price is overridden."""
    rows = table(spark, d, "part").select(key().alias("p_partkey"), key().cast("string").alias("id"), S.clean_text(F.when(key() % 11 == 0, " None ").otherwise(F.col("p_name"))).alias("title"), F.col("p_retailprice").alias("price"))
    kept = rows.filter((F.col("title") != "") & ~F.col("id").isin("7"))
    return kept.select("id", "title", F.when(F.col("p_partkey") % 50 == 3, 9.99).otherwise(F.col("price")).alias("price"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CASE p_partkey % 3 WHEN 0 THEN 'a:' ELSE '' END || p_brand AS rest FROM part")
def p23_after_first(spark: SparkSession, d: str) -> DataFrame:
    """The id behind the first colon, whatever follows."""
    tail = F.concat(F.when(key() % 3 == 0, "a:").otherwise(""), "p_brand")
    return table(spark, d, "part").select(key().cast("string").alias("id"), S.after_first(F.concat(F.lit("sector:"), tail)).alias("rest"))
