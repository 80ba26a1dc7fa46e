"""Information-theoretic sanitisation of personal data, in DataFrame operations alone.

Base spans are e-mail addresses, IP addresses, card and phone numbers.  Each value found is a
protected entity.  The words of the texts that hold it, wherever they stand outside of base spans,
are candidate terms; corpus co-occurrence estimates how strongly a term reveals the entity: with
n(t, e) distinct texts that hold both and n(t) distinct texts of the corpus that hold the term,
p(e | t) = n(t, e) / n(t), and log2(p(e | t) / p(e)) are the bits that the term discloses.  A term
that reaches the thresholds (at least ``MIN_CONTEXTS`` texts, ``MIN_SHARE`` and ``MIN_BITS``) for any
entity is a span of kind term wherever it stands, in every text; ``sanitised`` removes a term that
discloses nearly everything and generalises all other spans to a placeholder.

Copies of a text count once in every one of these numbers.

The patterns are rewritten so that Java's engine neither recurses nor backtracks over long
runs: single separators between digits and single dots between labels are first replaced, one
character by one, by private-use characters, which leaves only loops over one class.

Defined cases: a null text counts as empty; empty texts have no spans; a null doc_id keeps its
row; repeated rows get the same spans each; an empty table gives an empty result; extra columns
are not read by ``find_spans`` and kept by ``sanitised``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relevara.llm.common import checked, keyed, same_key, ship, text_session, written

#: Kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "term")
#: Disclosure thresholds: distinct texts, share of the term's documents, bits.
MIN_CONTEXTS, MIN_SHARE, MIN_BITS = 3, 0.5, 4.0
#: From this share on a term is removed, not generalised.
REMOVE_SHARE = 0.95
#: Shortest term.
TERM_CHARS = 4
#: Matches whose places are found together.
BLOCK = 256

#: Private-use characters that stand for a dot between labels, a separator between digits, and themselves.
DOT, JOINT, OTHER = "\ue000", "\ue001", "\ue002"
#: What stands for a base span when words are cut; a MARK of the text itself is followed by another letter.
MARK = "\ue003"
MASK = MARK + "m"
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{DOT}{_LOCAL}]))[{DOT}{_LOCAL}]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = f"[0-9][0-9{JOINT}]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"[^\x20\x09-\x0D]++"
SPAN = "struct<start:int,kind:int,end:int,value:string>"


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def located(text: Column, pattern: str, keep: Callable[[Column], Column] = lambda _: F.lit(True)) -> Column:
    """array<struct<start, end, value>> of all matches, leftmost and non-overlapping, whose value ``keep`` takes, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("value")), lambda p: p["value"].isNotNull())
    none, spans = F.array().cast("array<int>"), F.array().cast("array<struct<start:int,end:int,value:string>>")

    def cut(all_: Column) -> Column:  # an array that grows by one is copied each time, so only arrays of BLOCK places grow
        many = F.when(F.size(all_) > 0, F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))).otherwise(none)
        return F.transform(many, lambda i: F.slice(all_, i * BLOCK + 1, F.lit(BLOCK)))

    def starts(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["value"])))
        grown = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(sizes, grown, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def step(s: Column, p: Column) -> Column:
        start = s["at"] + F.length(p["gap"])
        end = start + F.length(p["value"])
        more = F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value"))))
        return F.struct(end.alias("at"), F.when(keep(p["value"]), more).otherwise(s["out"]).alias("out"))

    def placed(blocks: Column) -> Column:
        return F.flatten(F.zip_with(blocks, starts(blocks), lambda b, at: F.aggregate(b, F.struct(at.alias("at"), spans.alias("out")), step, lambda s: s["out"])))

    return once(pairs, lambda p: once(cut(p), placed))


def luhn(digits: Column) -> Column:
    """Whether a short string of digits passes the Luhn check."""
    at = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        d = F.substr(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(at, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<SPAN> of the base kinds, sorted by start, then kind."""
    plain = F.translate(text, DOT + JOINT, OTHER * 2)
    none = F.array().cast(f"array<{SPAN}>")
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")

    def kind(n: int, source: Column, pattern: str, has: Column, fine) -> Column:
        named = F.transform(located(source, pattern), lambda m: F.struct(m["start"].alias("start"), F.lit(n).alias("kind"), m["end"].alias("end"), F.translate(m["value"], DOT, ".").alias("value")))
        return F.when(has, F.filter(named, lambda s: fine(s["value"]))).otherwise(none)

    dotted = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
    joined = F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", JOINT)
    short = lambda p: F.ltrim(p, F.lit("0"))
    parts = lambda v: F.forall(F.split(v, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.coalesce(short(p).try_cast("int"), F.lit(0)) <= 255))
    n_digits = lambda v, low, high: F.length(digits(v)).between(low, high)
    return F.array_sort(
        F.concat(
            kind(0, dotted, EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
            kind(1, plain, IP, F.col("_digits"), parts),
            kind(2, joined, CARD, F.col("_digits"), lambda v: F.when(n_digits(v, 14, 19), luhn(digits(v))).otherwise(F.lit(False))),
            kind(3, plain, PHONE, F.contains(text, F.lit("+")), lambda v: n_digits(v, 10, 15)),
        )
    )


def span_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, base: Column) -> Column:
    """``text`` with ``MASK`` in place of each base span; a mark that stands in the text itself is escaped."""
    plain = lambda x: F.replace(x, F.lit(MARK), F.lit(MARK + "o"))

    def step(s: Column, p: Column) -> Column:
        out = F.when(p["start"] >= s["at"], F.concat(s["out"], plain(F.substr(text, s["at"] + 1, p["start"] - s["at"])), F.lit(MASK))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], p["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(base) == 0, plain(text)).otherwise(F.aggregate(base, start, step, lambda s: F.concat(s["out"], plain(F.substr(text, s["at"] + 1, F.length(text))))))


def candidates(text: Column, base: Column) -> Column:
    """The distinct lower-cased words of at least ``TERM_CHARS`` characters that touch no base span."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(masked(text, base)), F.lit(WORD), F.lit(0)))
    free = F.filter(words, lambda w: (F.length(w) >= TERM_CHARS) & ~F.contains(w, F.lit(MASK)))
    unescaped = F.filter(F.transform(free, lambda w: F.replace(w, F.lit(MARK + "o"), F.lit(MARK))), lambda w: F.length(w) >= TERM_CHARS)
    return F.when(F.contains(text, F.lit(MARK)), unescaped).otherwise(free)


def revealing_terms(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """(term, share): terms that disclose an entity, with their highest share.

    ``texts`` (text_hash, entities, words) has each distinct text once; every count is one of texts.
    """
    # a pair needs MIN_CONTEXTS texts, so entity and term each do, and no more of the term's than the share allows
    entities = texts.select("text_hash", F.explode("entities").alias("entity"))
    often = written(spark, entities.groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= MIN_CONTEXTS))
    if not often.limit(1).count():
        return often.select(F.lit("").alias("term"), F.lit(1.0).alias("share")).limit(0)
    counts = texts.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    most = often.agg(F.max("n_e")).first()[0]
    counts = written(spark, counts.filter((F.col("n_t") >= MIN_CONTEXTS) & (F.col("n_t") * MIN_SHARE <= most)))
    held = written(spark, entities.join(checked(often), "entity").select(F.col("text_hash").alias("held_by"), "entity", "n_e"))
    per_text = held.groupBy("held_by").agg(F.max("n_e").alias("most"))
    words = texts.select("text_hash", "words").join(checked(per_text), F.col("text_hash") == F.col("held_by")).select("text_hash", "most", F.explode("words").alias("term"))
    words = words.join(checked(counts), "term").filter(F.col("n_t") * MIN_SHARE <= F.col("most")).select("text_hash", "term", "n_t")
    pairs = words.join(checked(held), (F.col("text_hash") == F.col("held_by")) & (F.col("n_t") * MIN_SHARE <= F.col("n_e")))
    both = pairs.groupBy("entity", "term", "n_e", "n_t").agg(F.count("*").alias("n_te")).filter(F.col("n_te") >= MIN_CONTEXTS)
    share = F.col("n_te") / F.col("n_t")
    found = both.select("term", share.alias("share"), F.log2(share * texts.count() / F.col("n_e")).alias("bits"))
    return found.filter((F.col("share") >= MIN_SHARE) & (F.col("bits") >= MIN_BITS)).groupBy("term").agg(F.max("share").alias("share"))


def find_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash, base (array of spans), all (with those of terms)."""
    text_session(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    spans = flat.withColumn("_digits", F.col("text").rlike("[0-9]")).withColumn("base", base_spans(F.col("text"))).drop("_digits")
    entities = F.array_distinct(F.transform("base", lambda s: F.xxhash64(s["value"])))
    rows = written(spark, spans.select("doc_id", "text_hash", "base", entities.alias("entities"), candidates(F.col("text"), F.col("base")).alias("words"), F.monotonically_increasing_id().alias("uid")))
    # each distinct text once: of copies, all rows but the first are left out of the counts
    first = rows.groupBy("text_hash").agg(F.min("uid").alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = written(spark, first.select(F.col("text_hash").alias("copied"), "first"))
    spare = written(spark, rows.select("text_hash", "uid").join(checked(first), F.col("text_hash") == F.col("copied")).filter("uid > first").select("uid"))
    texts = rows.join(checked(spare), "uid", "left_anti").select("text_hash", "entities", "words")
    terms = written(spark, revealing_terms(spark, texts))
    # the terms of each distinct text that holds any, then every place of theirs in it
    marked = texts.select("text_hash", F.explode("words").alias("term")).join(checked(terms), "term")
    marked = written(spark, marked.groupBy("text_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("revealing")).withColumnRenamed("text_hash", "h"))
    own = spans.join(checked(marked), F.col("text_hash") == F.col("h"))
    place = located(F.col("text"), WORD, lambda w: F.map_contains_key("revealing", F.lower(w)))
    clear = F.filter(place, lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    placed = own.dropDuplicates(["text_hash"]).select("text_hash", "revealing", clear.alias("places"))
    share_of = lambda w: F.try_element_at("revealing", F.lower(w["value"]))
    term = lambda w: F.struct(w["start"].alias("start"), F.lit(4).alias("kind"), w["end"].alias("end"), F.lower(w["value"]).alias("value"))
    shares = F.map_from_entries(F.transform("places", lambda w: F.struct(w["start"].alias("start"), share_of(w).alias("share"))))
    per = written(spark, placed.select(F.col("text_hash").alias("h"), F.transform("places", term).alias("terms"), shares.alias("shares")))
    out = rows.join(checked(per), F.col("text_hash") == F.col("h"), "left")
    every = F.array_sort(F.concat("base", F.coalesce("terms", F.array().cast(f"array<{SPAN}>"))))
    return out.select("doc_id", "text_hash", "base", every.alias("all"), "shares")


def sanitised(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the text of each span generalised to <KIND>, or removed if a term's share is high."""
    one = spans.filter(F.size("all") > 0).dropDuplicates(["doc_id", "text_hash"])
    both = keyed(docs).join(one, same_key(one), "left")
    word, text = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS]), F.col("row.text")

    def step(s: Column, p: Column) -> Column:
        share = F.coalesce(F.when(F.col("shares").isNotNull() & (p["kind"] == 4), F.try_element_at("shares", p["start"])), F.lit(0.0))
        put = F.when(share >= REMOVE_SHARE, "").otherwise(F.element_at(word, p["kind"] + 1))
        gap = F.substr(text, s["at"] + 1, p["start"] - s["at"])
        out = F.when(p["start"] >= s["at"], F.concat(s["out"], gap, put)).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], p["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("all", start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))))
    new = F.when(F.col("all").isNull(), text).otherwise(clean)
    return both.select(*[new.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


ship(__name__)
