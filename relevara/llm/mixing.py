"""Mixing of sources to target weights by entropy balancing.

Every document gets a rate between 0 and ``most``.  Among all rates that give each source its
target number of words, those of largest entropy are exponentially tilted,
r = most * e^z / (most - 1 + e^z) with z = tilt(source) * size, and the tilts minimise a
convex dual.  Newton iterations solve it for all sources at once; each iteration is one sum
over the histogram of sizes per source.  Rates become whole copies by systematic rounding along
the sizes, and what rounding leaves is closed by copies of documents of about that size.

Sums are taken in fixed-point numbers, so that reruns agree to the last digit.

Defined cases: a null text has size 0 and is never copied; a null source is a source of its
own, the last; a null doc_id is allowed; repeated rows share their copies evenly; a source
without words has target 0; an empty table gives an empty result; extra columns are kept by
``remixed`` and not read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevara.llm.common import checked, keyed, same_key, ship, text_session, written

#: Newton steps; each is kept inside the bracket of the ones before.
STEPS = 24
#: Rates are whole multiples of 1 / UNIT.
UNIT = 1_000_000
#: Rounds that close what rounding has left.
ROUNDS = 6
#: Parts of the documents of a cell; fixed, as it decides which documents get its copies.
PARTS = 256


def word_count(text: Column) -> Column:
    """Number of runs of other characters than space and \\x09-\\x0D."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(plain, " "), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, weights: list[int], most: int) -> DataFrame:
    """(source, source_size, target): the total shared by weight, none above ``most`` times its size.

    A source is full when its size per weight is small; in that order each prefix of full
    sources leaves a level for the rest, and the right prefix is the longest whose sources
    all lie below their level.
    """
    rank = Window.orderBy(F.col("source").isNull(), F.hex(F.encode("source", "UTF-8")))
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    limit = ranked.withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = limit.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    full = level.withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    first = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return full.withColumn("at", first).select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(F.col("w") * F.col("at"), F.col("cap").cast("double"))).alias("target"))


def rate(tilt: Column, scaled: Column, most: int) -> Column:
    """The tilted rate of a document; exp never overflows."""
    z = F.least(F.greatest(tilt * scaled, F.lit(-700.0)), F.lit(700.0))
    return most / (1 + (most - 1) * F.exp(-z))


def solved(spark: SparkSession, histogram: DataFrame, goal: DataFrame, most: int, steps: int = STEPS) -> DataFrame:
    """(source, target, source_size, mean, tilt) by Newton steps on the dual, one sum per source each."""
    duals = goal.select("source", "target", "source_size", "mean", F.lit(0.0).alias("tilt"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"))
    duals = written(spark, duals)
    for _ in range(steps):
        each = histogram.join(checked(duals), histogram["source"].eqNullSafe(duals["source"]))
        scaled = F.col("size") / F.col("mean")
        r = rate(F.col("tilt"), scaled, most)
        fixed = lambda x: F.sum((x * UNIT).cast("decimal(38,0)")).cast("double") / UNIT
        sums = each.groupBy(duals["source"].alias("s")).agg(fixed(F.col("n") * scaled * r).alias("value"), fixed(F.col("n") * scaled * scaled * r * (1 - r / most)).alias("slope"))
        new = duals.join(checked(sums), duals["source"].eqNullSafe(F.col("s")), "left")
        gap = F.col("value") - F.col("target") / F.col("mean")
        lo, hi = F.when(gap < 0, F.col("tilt")).otherwise(F.col("lo")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("hi"))
        new = new.select("source", "target", "source_size", "mean", "tilt", gap.alias("gap"), "slope", lo.alias("lo"), hi.alias("hi"))
        step = F.col("tilt") - F.try_divide(F.col("gap"), F.col("slope"))
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        tilt = F.when(F.col("gap").isNull() | (F.col("gap") == 0), F.col("tilt")).when(F.coalesce(inside, F.lit(False)), step).otherwise((F.col("lo") + F.col("hi")) / 2)
        duals = written(spark, new.select("source", "target", "source_size", "mean", tilt.alias("tilt"), "lo", "hi", F.coalesce(F.abs("gap") * F.col("mean"), F.lit(0.0)).alias("off")))
        if not duals.filter(F.col("off") > 0.5 + F.col("target") * 1e-6).limit(1).count():
            break
    return duals


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken, text_hash."""
    text_session(spark)
    rows = written(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), word_count(F.col("text")).alias("size")))
    histogram = written(spark, rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    goal = written(spark, targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), list(weights), most))
    mean = histogram.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("m")).select(F.col("source").alias("ms"), "m")
    goal = written(spark, goal.join(checked(mean), goal["source"].eqNullSafe(F.col("ms"))).select("source", "source_size", "target", F.greatest("m", F.lit(1.0)).alias("mean")))
    duals = solved(spark, histogram.filter("size > 0"), goal, most)
    # what all documents of a source and size get together: running sums of rates along the sizes
    cells = histogram.join(checked(duals.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    unit = F.when(F.col("target") >= F.col("source_size") * most, F.lit(most * UNIT)).otherwise((rate(F.col("tilt"), F.col("size") / F.col("mean"), most) * UNIT).cast("long"))
    cells = cells.withColumn("unit", F.when(F.col("size") > 0, unit).otherwise(F.lit(0)).cast("long"))
    along = Window.partitionBy("source").orderBy("size")
    run = F.sum(F.col("unit") * F.col("n")).over(along)
    cells = cells.withColumn("upto", F.floor(run / UNIT)).withColumn("copies", F.col("upto") - F.coalesce(F.lag("upto").over(along), F.lit(0)))
    cells = written(spark, cells.select("source", "size", "n", "target", "source_size", F.least(F.col("copies"), F.col("n") * most).cast("long").alias("copies")))
    cells = closed(spark, cells, most)
    return placed(spark, rows, cells)


def closed(spark: SparkSession, cells: DataFrame, most: int, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` with copies added or removed so that each source comes near its target.

    Each round takes, per source, the size and number of copies that leave least.
    """
    for _ in range(rounds):
        left = cells.groupBy("source").agg((F.round(F.max("target")).cast("long") - F.sum(F.col("size") * F.col("copies"))).alias("gap")).filter("gap <> 0")
        left = left.withColumnRenamed("source", "s")
        open_ = cells.filter("size > 0").join(checked(left), F.col("source").eqNullSafe(F.col("s")))
        times = F.least(F.floor(F.abs("gap") / F.col("size") + 0.5), F.when(F.col("gap") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies")))
        move = open_.withColumn("k", (F.signum("gap") * times).cast("long")).filter("k <> 0")
        after = F.abs(F.col("gap") - F.col("k") * F.col("size"))
        best = move.filter(after < F.abs("gap")).groupBy("s").agg(F.min_by(F.struct("size", "k"), F.struct(after, F.col("size"))).alias("best"))
        best = written(spark, best.select("s", F.col("best.size").alias("at"), "best.k"))
        if not best.limit(1).count():
            break
        new = cells.join(checked(best), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("at")), "left")
        cells = written(spark, new.select("source", "size", "n", "target", "source_size", (F.col("copies") + F.coalesce("k", F.lit(0))).alias("copies")))
    return cells


def placed(spark: SparkSession, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Copies of each document: the documents of a cell share its copies evenly, in a fixed order.

    A cell may hold most rows, so the rank in it is a rank in one of many parts plus the
    counts of the parts before.
    """
    part = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << 20)) % PARTS
    dealt = rows.withColumn("part", part.cast("int"))
    own = Window.partitionBy("source", "size", "part").orderBy(F.col("doc_id").isNull(), "doc_id", "text_hash")
    ranked = dealt.withColumn("rank", F.row_number().over(own) - 1)
    counts = dealt.groupBy("source", "size", "part").agg(F.count("*").alias("in_part"))
    before = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("before"))
    c = cells.select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "target", "source_size", F.col("copies").alias("all_copies"))
    shift = shift.join(checked(c.withColumnsRenamed({"s": "cs", "z": "cz"})), F.col("s").eqNullSafe(F.col("cs")) & (F.col("z") == F.col("cz"))).drop("cs", "cz")
    shift = written(spark, shift)
    full = ranked.join(checked(shift), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p")))
    at = F.col("rank") + F.col("before")
    share = lambda k: F.expr(f"(CAST({k} AS DECIMAL(38,0)) * all_copies) div n")
    full = full.withColumn("at", at).withColumn("copies", (share("(at + 1)") - share("at")).cast("int"))
    return full.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "text_hash")


def remixed(spark: SparkSession, docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``docs`` with every row as often as ``mixed`` says; all columns stay.

    Rows that agree in doc_id and text give their copies to one of them.
    """
    keys = mixed.groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    few = written(spark, keys.filter("copies <> n OR n > 1"))
    named, side = keyed(docs), checked(few)
    joined = named.join(side, same_key(side), "left").select("row", "key_id", "key_hash", "copies", "n")
    once = joined.filter("n IS NULL OR n = 1").withColumn("copies", F.coalesce("copies", F.lit(1)))
    if few.filter("n > 1").limit(1).count():
        once = once.unionByName(joined.filter("n > 1").dropDuplicates(["key_id", "key_hash"]))
    return once.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


ship(__name__)
