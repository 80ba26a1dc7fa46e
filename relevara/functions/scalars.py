"""Scalar functions as Column expressions; all stay in the JVM.

White space is ASCII white space, and numbers parse as Spark's try_cast does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
LABELS = ("Exact", "Substitute", "Complementary", "Irrelevant")
GAIN_CODES = {"Exact": 100, "Substitute": 10, "Complementary": 1, "Irrelevant": 0}
EMPTY_TOKENS = ("", "nan", "none", "null", "n/a", "na", "<na>")
STOP_WORDS = tuple(
    """a an and are as at be best but by can cheap do for from
good has have how i in is it me my need needs of on or that the this to
under what when where which will with without you your something anything
help helps looking want""".split()
)


def norm_id(raw: Column) -> Column:
    return F.replace(F.lower(raw.cast("string")), F.lit("-"), F.lit(""))


def canonical_label(label: Column) -> Column:
    """First letter upper case, rest lower; the short form of Complementary is written out; null if unknown."""
    t = F.trim(label)
    t = F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substring(t, 2, 1 << 20)))
    t = F.when(t == "Complement", "Complementary").otherwise(t)
    return F.when(t.isin(*LABELS), t)


def gain_code(label: Column) -> Column:
    """100, 10, 1 or 0; an unknown label is an error."""
    out = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))).cast("int")
    for name, code in GAIN_CODES.items():
        out = F.when(canonical_label(label) == name, F.lit(code)).otherwise(out)
    return out


def clean_text(x: Column) -> Column:
    """Trimmed; null and tokens that stand for nothing become ''."""
    t = F.trim(x)
    return F.when(x.isNull() | F.lower(t).isin(*EMPTY_TOKENS), "").otherwise(t)


def clean_text_upload(x: Column) -> Column:
    """The upload's rule: only null and nan become ''."""
    t = F.trim(x)
    return F.when(x.isNull() | (F.lower(t) == "nan"), "").otherwise(t)


def clean_price(x: Column) -> Column:
    """The lower bound of a range; digits, dots and signs only; no price with two dots."""
    low = F.try_element_at(F.split(x, " - "), F.lit(1))
    kept = F.regexp_replace(F.regexp_replace(low, r"[^0-9.\-]", ""), r"^[.\-]+|[.\-]+$", "")
    return F.when(~kept.rlike(r"\..*\."), kept.try_cast("double"))


def to_float(x: Column) -> Column:
    d = F.trim(x).try_cast("double")
    return F.when((d >= 0) & ~F.isnan(d), d)


def extract_number(x: Column) -> Column:
    return F.coalesce(to_float(x), F.regexp_extract(x, r"[0-9]+(\.[0-9]+)?", 0).try_cast("double"))


def is_http_url(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).rlike("^https?://"), F.lit(False))


def strip_html(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]*>", " "), r"[ \t\n\r]+", " "))


def path(parts: Column) -> Column:
    return F.array_join(F.filter(F.transform(parts, clean_text), lambda p: p != ""), " > ")


def category_pick(x: Column, leaf: bool = True) -> Column:
    parts = F.filter(F.transform(F.split(x, ">>|>"), lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1 if leaf else 1)), F.lit(""))


def namespaced(sector: Column, raw: Column) -> Column:
    return F.when(F.coalesce(raw, F.lit("")) == "", "").otherwise(F.concat_ws(":", sector, raw))


def last_segment(x: Column) -> Column:
    return F.substring_index(x, ":", -1)


def after_first(x: Column) -> Column:
    return F.when(F.contains(x, F.lit(":")), F.regexp_extract(x, "^[^:]*:(.*)$", 1)).otherwise(x)


def url_tail(x: Column) -> Column:
    return F.regexp_extract(x, "([^/]+)/*$", 1)


def discount_percent(original: Column, discounted: Column) -> Column:
    """Percent off with two decimals, where both are known."""
    return F.when((original > 0) & discounted.isNotNull(), F.round((original - discounted) / original * 100, 2))


def tokens(x: Column) -> Column:
    found = F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS))


def word_coverage(query: Column, doc: Column) -> Column:
    """Share of the query's distinct tokens that the document has."""
    q = F.array_distinct(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, doc)) / F.size(q))


def truncated(x: Column) -> Column:
    return F.floor(x * 100) / 100
