"""Answers of judges and services as Column expressions: lists in free text, validation, errors, costs, quotas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relevara.functions.scalars import canonical_label

# fixed values
TRANSIENT_CODES = ("429", "RESOURCE_EXHAUSTED", "500", "503", "UNAVAILABLE")
TRANSIENT_WORDS = ("quota", "disconnect", "timeout", "timed out", "connection", "deadline")
LONGEST_WAIT = 120.0
#: Characters between the word retry and its number.
NEAR = 24
ANSWER = "array<struct<index:int,label:string,reasoning:string>>"


def answer_list(text: Column, greedy: bool = True) -> Column:
    """The JSON array inside a text: up to its last bracket, or, not greedy, up to the first one."""
    found = F.regexp_extract(text, r"(?s)\[.*\]" if greedy else r"(?s)\[.*?\]", 0)
    # as a member of an object, so that text behind the list makes it no JSON
    return F.when(found != "", F.from_json(F.concat(F.lit('{"x":'), found, F.lit("}")), f"x {ANSWER}")["x"])


def validated(text: Column, n_items: Column, rationale: bool = False) -> Column:
    """struct<error, labels, reasonings>: one canonical label for each item from 1 on, the last answer of an index counts."""
    answers = answer_list(text)
    of = lambda i: F.try_element_at(F.filter(answers, lambda a: a["index"] == i), F.lit(-1))
    numbers = F.filter(F.sequence(F.lit(0), n_items), lambda i: i > 0)
    missing = F.filter(numbers, lambda i: ~F.exists(answers, lambda a: a["index"] == i))
    unknown = F.filter(numbers, lambda i: canonical_label(of(i)["label"]).isNull())
    silent = F.filter(numbers, lambda i: F.coalesce(F.trim(of(i)["reasoning"]), F.lit("")) == "")
    error = (
        F.when(answers.isNull(), "no list")
        .when(F.exists(answers, lambda a: a["index"].isNull()), "item without index")
        .when(F.size(missing) > 0, F.concat(F.lit("missing index "), F.element_at(missing, 1).cast("string")))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown label at "), F.element_at(unknown, 1).cast("string")))
    )
    if rationale:
        error = error.when(F.size(silent) > 0, F.concat(F.lit("no reasoning at "), F.element_at(silent, 1).cast("string")))
    labels = F.transform(numbers, lambda i: canonical_label(of(i)["label"]))
    reasons = F.transform(numbers, lambda i: F.coalesce(of(i)["reasoning"], F.lit("")))
    return F.struct(error.alias("error"), F.when(error.isNull(), labels).alias("labels"), F.when(error.isNull(), reasons).alias("reasonings"))


def retry_seconds(error: Column) -> Column:
    """The wait that an error text names, at most LONGEST_WAIT; null without one: the first number that follows the word retry within NEAR characters."""
    found = F.nullif(F.regexp_extract(F.lower(error), rf"retry[^0-9]{{1,{NEAR}}}([0-9]+(?:[.][0-9]+)?)", 1), F.lit("")).try_cast("double")
    return F.when(found.isNotNull(), F.least(found, F.lit(LONGEST_WAIT)))


def error_class(error: Column, with_images: Column) -> Column:
    """transient: wait and try again; without_images: try again with text alone; other: try again."""
    codes = [F.contains(error, F.lit(c)) for c in TRANSIENT_CODES]
    words = [F.contains(F.lower(error), F.lit(w)) for w in TRANSIENT_WORDS]
    transient = codes[0]
    for c in [*codes[1:], *words]:
        transient = transient | c
    return F.when(error.isNull(), None).when(transient, "transient").when(with_images, "without_images").otherwise("other")


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Prices are for a million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def percent_text(x: Column, signed: bool = False) -> Column:
    """A share in percent with two decimals, n/a for null."""
    return F.when(x.isNotNull(), F.format_string("%+.2f" if signed else "%.2f", x * 100)).otherwise("n/a")


def quotas(totals: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """(…, tier, quota): the floor of each share of ``total``; what is left goes to the first tiers, one each."""
    tiers = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("tier"), F.lit(float(s)).alias("share")) for i, (t, s) in enumerate(shares.items())])
    each = totals.withColumn("t", F.explode(tiers)).select(*totals.columns, "t.*").withColumn("floor", F.floor(F.col("total") * F.col("share")))
    left = F.col("total") - F.sum("floor").over(Window.partitionBy(*totals.columns))
    return each.withColumn("quota", F.col("floor") + (F.col("i") < left).cast("long")).drop("i", "share", "floor")
