"""Joins around judgments: fallbacks, label sources, runs, batches, and the audit of queries without an exact product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relevara.functions.scalars import LABELS

FAILED = "judge failed after retries"


def reusable(judged: DataFrame) -> DataFrame:
    """Judgments that may be used again: with a label, and no failed ones."""
    return judged.filter(F.col("label").isNotNull() & ~F.col("reasoning").eqNullSafe(F.lit(FAILED)))


def judged_with_fallback(hits: DataFrame, cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Each hit with its label: from the cache, else newly judged, else Irrelevant as failed; ``source`` tells which."""
    keys = ["query_id", "raw_id"]
    known = hits.join(cache.select(*keys, F.col("label").alias("cached")), keys, "left").join(fresh.select(*keys, F.col("label").alias("new")), keys, "left")
    source = F.when(F.col("cached").isNotNull(), "cache").when(F.col("new").isNotNull(), "fresh").otherwise("failed")
    return known.withColumn("source", source).withColumn("label", F.coalesce("cached", "new", F.lit("Irrelevant"))).drop("cached", "new")


def label_or(shipped: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The other set's label where it has a known one, the shipped label elsewhere."""
    both = shipped.join(other.select(*keys, F.col("label").alias("other")), keys, "left")
    fine = F.when(F.col("other").isin(*LABELS), F.col("other"))
    return both.withColumn("from_other", fine.isNotNull()).withColumn("label", F.coalesce(fine, "label")).drop("other")


def needs_run(queries: DataFrame, done: DataFrame, engines: tuple[str, ...]) -> DataFrame:
    """Queries with text that lack an engine or have one with an error."""
    good = done.filter(F.col("engine").isin(*engines) & F.col("error").isNull()).select("query_id", "engine").distinct()
    whole = good.groupBy("query_id").agg(F.count("*").alias("k")).filter(F.col("k") == len(engines))
    return queries.filter(F.coalesce("text_query", F.lit("")) != "").join(whole, "query_id", "left_anti")


def chunked(items: DataFrame, key: str, order: list[str], most_images: int, most_bytes: int) -> DataFrame:
    """(…, chunk): items of a key in order; a new chunk starts where one more would be over either bound.

    ``items`` has has_image (0, 1) and bytes; a key's items are one list, as they go to one call.
    """
    own = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, "has_image", "bytes"))).alias("items"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("n"), F.lit(0).alias("images"), F.lit(0).cast("long").alias("bytes"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        full = (s["n"] > 0) & ((s["images"] + x["has_image"] > most_images) | (s["bytes"] + x["bytes"] > most_bytes))
        chunk = s["chunk"] + full.cast("int")
        keep = lambda v: F.when(full, 0).otherwise(v)
        return F.struct(chunk.alias("chunk"), (keep(s["n"]) + 1).alias("n"), (keep(s["images"]) + x["has_image"]).alias("images"), (keep(s["bytes"]) + x["bytes"]).cast("long").alias("bytes"), F.concat(s["out"], F.array(chunk)).alias("out"))

    dealt = own.withColumn("c", F.aggregate("items", start, step, lambda s: s["out"]))
    return dealt.select(key, F.explode(F.arrays_zip("items", "c")).alias("z")).select(key, "z.items.*", F.col("z.c").alias("chunk"))


def returned(hits: DataFrame) -> DataFrame:
    """(query_id, norm_id, original_gain, original_label): what engines returned, with its largest gain; on ties the first label."""
    best = F.max_by("label", F.struct("gain_code", (-F.col("rank")).alias("r"), "engine"))
    return hits.groupBy("query_id", "norm_id").agg(F.max("gain_code").alias("original_gain"), best.alias("original_label"))


def enriched(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """Candidates (query_id, norm_id) with was_returned and original_label."""
    own = returned(hits)
    return candidates.join(own, ["query_id", "norm_id"], "left").withColumn("was_returned", F.col("original_gain").isNotNull())


def audited(queries: DataFrame, candidates: DataFrame, hits: DataFrame, least: int = 10, coverage: float = 0.5, failures: float = 0.3) -> DataFrame:
    """The audit class of each query.

    ``candidates`` has query_id, code (judged gain), coverage, was_returned and failed.  A fresh Exact is
    one that no engine returned; a stale one was returned and judged otherwise.
    """
    ok, exact = ~F.col("failed"), F.col("code") == 100
    per = candidates.groupBy("query_id").agg(
        F.count_if(ok & exact & ~F.col("was_returned")).alias("n_fresh"),
        F.count_if(ok & exact & F.col("was_returned")).alias("n_stale"),
        F.max(F.when(ok, F.col("code"))).alias("best_new"),
        F.max("coverage").alias("best_coverage"),
        F.count("*").alias("n_candidates"),
        F.count_if("failed").alias("n_failed"),
    )
    before = hits.groupBy("query_id").agg(F.max("gain_code").alias("best_original"))
    rows = queries.join(per, "query_id", "left").join(before, "query_id", "left").na.fill(0)
    share = F.when(F.col("n_candidates") > 0, F.col("n_failed") / F.col("n_candidates")).otherwise(1.0)
    sure = (F.col("n_candidates") >= least) & (F.col("best_coverage") >= coverage) & (share <= failures)
    some = F.col("best_new").isin(1, 10) | F.col("best_original").isin(1, 10)
    kind = F.when(F.col("n_fresh") > 0, "engines-missed").when(F.col("n_stale") > 0, "inconclusive").when(some, "partial").when(sure, "catalog-gap").otherwise("inconclusive")
    return rows.withColumn("audit_class", kind)


def pilot(queries: DataFrame, special: str, per_tier: int = 3) -> list[dict]:
    """A pilot of ``per_tier`` queries of each tier: two with many images in other sectors and tiers, the largest
    of the special sector, then the nearest to the median size, sectors not yet used first.

    ``queries`` has query_id, sector, tier, n_items, n_images.  Every pick is one top-1 query; only the picks
    come to the driver.
    """
    chosen: list[dict] = []

    def take(rows: DataFrame, *order: Column) -> bool:
        best = rows.orderBy(*order, "query_id").limit(1).collect()
        chosen.extend(r.asDict() for r in best)
        return bool(best)

    usual = queries.filter(F.col("sector") != special)
    take(usual, F.desc("n_images"))
    if chosen:
        take(usual.filter((F.col("sector") != chosen[0]["sector"]) & (F.col("tier") != chosen[0]["tier"])), F.desc("n_images"))
    take(queries.filter(F.col("sector") == special), F.desc("n_items"))
    n = queries.count()
    order = Window.orderBy("n_items")
    sizes = queries.groupBy("n_items").count().withColumn("upto", F.sum("count").over(order))  # one row per size
    middle = sizes.filter(F.col("upto") > n // 2).agg(F.min("n_items")).first()[0]
    for tier in [r["tier"] for r in queries.select("tier").distinct().orderBy("tier").collect()]:
        while sum(c["tier"] == tier for c in chosen) < per_tier:
            rest = queries.filter((F.col("tier") == tier) & ~F.col("query_id").isin([c["query_id"] for c in chosen]))
            used = F.col("sector").isin([c["sector"] for c in chosen])
            if not take(rest, used.cast("int"), F.abs(F.col("n_items") - middle)):
                break
    return chosen
