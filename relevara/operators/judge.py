"""Batched judging by a pluggable judge: one call for each query's products, failures and retries as data.

A call is a row: its query and the list of its products.  A round sends the calls that are left; what comes back is
the text of an answer or the text of an error, so that a failure is a row as well.  Answers are read by column
expressions; errors decide what the next round sends: a transient one sends the call again as it was, any other one
sends it without pictures first.  After the last round what is left gets the sentinel of a failed judgment.

A round goes in waves.  Each wave is a map over calls that were dealt before, written by its tasks into a folder
of its own and marked when it is complete: a lost executor costs the calls in flight in its tasks, and a run that
starts again over the same folder reads complete waves instead of judging twice.  Between waves the spending and the failures so far are looked at.
The first wave's tasks have few calls; how long a wave took bounds those of the next, so that a task takes seconds whatever the judge.
"""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relevara.functions.responses import answer_list, error_class
from relevara.functions.scalars import canonical_label
from relevara.operators.judging import FAILED
from relevara.sources.sinks import delete, exists

ITEM = "struct<item:int,product_id:string,title:string,description:string,price:double,discount_price:double,has_image:boolean>"
#: Rounds of a run, and calls of a task until a wave has shown how long they take.
ROUNDS, CALLS = 4, 16
#: Seconds that a later task's calls may take together, and most of its calls.
TASK_SECONDS, MOST_CALLS = 10.0, 1024
SENT = f"call_id string, query string, tier string, items array<{ITEM}>, attempt int, with_images boolean, wave int"
ANSWERED = "call_id string, text string, error string, cost long"


@dataclass(frozen=True)
class Call:
    """What a judge is asked: the products of one query, from 1 on, and which attempt this is."""

    call_id: str
    query: str
    tier: str
    items: list[dict[str, Any]]
    attempt: int
    with_images: bool


class Judge(Protocol):
    """A judge travels to the executors, so it must be picklable.

    ``ask`` returns (answer text, cost in millionths) and raises any exception where the call fails.
    """

    def ask(self, call: Call) -> tuple[str, int]: ...


@dataclass(frozen=True)
class RuleJudge:
    """A deterministic judge without a model: the share of the query's words that a product's title and description have."""

    exact: float = 0.75
    substitute: float = 0.5
    complementary: float = 0.25

    def label(self, query: str, item: dict[str, Any]) -> str:
        words = set(query.lower().split())
        have = set(f"{item.get('title') or ''} {item.get('description') or ''}".lower().split())
        share = len(words & have) / len(words) if words else 0.0
        return "Exact" if share >= self.exact else "Substitute" if share >= self.substitute else "Complementary" if share >= self.complementary else "Irrelevant"

    def ask(self, call: Call) -> tuple[str, int]:
        rows = [{"index": int(i["item"]), "label": self.label(call.query, i), "reasoning": "share of words"} for i in call.items]
        return "Judgments: " + json.dumps(rows), sum(len(i.get("title") or "") for i in call.items)


def calls_of(items: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """(call_id, query, tier, items): the products of each query as one call, numbered in the stated order.

    ``items`` has text_query, tier and the fields of a product; a call's products are those that engines returned for one
    query (``chunked`` bounds them where they may be many).
    """
    fields = [F.col(c) for c in ("product_id", "title", "description", "price", "discount_price", "has_image")]
    lists = items.groupBy(*keys, "text_query", "tier").agg(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *fields))).alias("x"))
    numbered = F.transform("x", lambda x, i: F.struct((i + 1).cast("int").alias("item"), *[x[c].alias(c) for c in ("product_id", "title", "description", "price", "discount_price", "has_image")]))
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    return lists.select(name.alias("call_id"), F.col("text_query").alias("query"), "tier", numbered.cast(f"array<{ITEM}>").alias("items"))


def asked(frames: Iterator[pd.DataFrame], judge: Judge) -> Iterator[pd.DataFrame]:
    """One answer or error for each call; an exception of one call is that call's error."""
    for frame in frames:
        out = []
        for r in frame.to_dict("records"):
            items = [dict(i) if isinstance(i, dict) else i.asDict() for i in r["items"]]
            try:
                text, cost = judge.ask(Call(r["call_id"], r["query"], r["tier"], items, int(r["attempt"]), bool(r["with_images"])))
                out.append((r["call_id"], text, None, cost))
            except Exception as e:  # noqa: BLE001 - whatever a judge raises is a failed call
                out.append((r["call_id"], None, str(e)[:300] or type(e).__name__, 0))
        yield pd.DataFrame(out, columns=["call_id", "text", "error", "cost"])


def readable(answers: DataFrame) -> DataFrame:
    """Answers without a list in their text count as errors."""
    no_list = F.col("error").isNull() & answer_list(F.col("text")).isNull()
    return answers.withColumn("error", F.when(no_list, F.lit("no list")).otherwise(F.col("error")))


@dataclass
class Pace:
    """Calls of a task: ``CALLS``, and after a wave as many as take ``TASK_SECONDS`` at its pace."""

    calls: int = CALLS

    def tasks(self, n: int, cores: int) -> int:
        """No fewer than cores, as long as each has more than ``CALLS``."""
        return max(1, -(-n // self.calls), min(cores, -(-n // CALLS)))

    def took(self, n: int, seconds: float) -> None:
        self.calls = int(min(MOST_CALLS, max(CALLS, TASK_SECONDS * n / max(seconds, 1e-3))))


def waves_of(spark: SparkSession, left: DataFrame, judge: Judge, folder: str, size: int, pace: Pace) -> Iterator[DataFrame]:
    """The answers to the calls that are left, wave by wave; complete waves of an earlier run are read."""
    cores = max(1, spark.sparkContext.defaultParallelism)
    plan = f"{folder}/calls"
    if not exists(spark, f"{plan}/_SUCCESS"):
        numbered = left.withColumn("wave", F.pmod(F.xxhash64("call_id"), F.lit(max(1, -(-left.count() // size)))).cast("int"))
        numbered.repartition("wave").write.mode("overwrite").partitionBy("wave").parquet(plan)
    calls = spark.read.schema(SENT).parquet(plan)
    for wave in sorted(r["wave"] for r in calls.select("wave").distinct().collect()):
        at = f"{folder}/answers-{wave}"
        if not exists(spark, f"{at}/_SUCCESS"):
            mine = calls.filter(F.col("wave") == wave)
            n = mine.count()
            tasks = pace.tasks(n, cores)
            # tasks of few calls, so that little is in flight when one is lost
            dealt = mine.repartition(tasks, "call_id").select("call_id", "query", "tier", "items", "attempt", "with_images")
            began = time.monotonic()
            dealt.mapInPandas(lambda frames: asked(frames, judge), ANSWERED).write.mode("overwrite").parquet(at)
            pace.took(n, (time.monotonic() - began) * min(tasks, cores))
        yield spark.read.schema(ANSWERED).parquet(at)


def judged(spark: SparkSession, calls: DataFrame, judge: Judge, folder: str, rounds: int = ROUNDS, wave: int = 10_000, budget: int | None = None, most_failures: int | None = None) -> DataFrame:
    """(call_id, product_id, item, label, reasoning, failed, attempts, with_images, status): one row per product of each call.

    ``calls`` is as ``calls_of`` gives it, with distinct ids.  status is ``ok``, ``failed`` (no answer in any round, or none for this product)
    or ``aborted`` (not asked any more, as the waves before cost more than ``budget`` or left more than
    ``most_failures`` calls without an answer in the last round).  ``folder`` keeps the waves and lets a run be taken up again.
    """
    own = calls.withColumns({"attempt": F.lit(1), "with_images": F.exists("items", lambda i: F.coalesce(i["has_image"], F.lit(False)))})
    done: list[DataFrame] = []
    pace = Pace()
    spent = failures = 0
    stopped = False
    for n in range(1, rounds + 1):
        at = f"{folder}/round-{n}"
        got: DataFrame | None = None
        for answers in waves_of(spark, own, judge, at, wave, pace):
            got = answers if got is None else got.unionByName(answers)
            if budget is not None or most_failures is not None:
                sums = answers.agg(F.sum("cost").alias("cost"), F.count_if(F.col("error").isNotNull()).alias("failed")).first()
                spent += sums["cost"] or 0
                failures += (sums["failed"] or 0) if n == rounds else 0
                stopped = (budget is not None and spent > budget) or (most_failures is not None and failures > most_failures)
                if stopped:
                    break
        if got is None:
            break
        sent = spark.read.schema(SENT).parquet(f"{at}/calls").drop("wave")
        state = sent.join(readable(got), "call_id")
        done.append(state.filter("error IS NULL").select("call_id", "text", "attempt", "with_images"))
        kind = error_class(F.col("error"), F.col("with_images"))
        again = state.filter("error IS NOT NULL").select("call_id", "query", "tier", "items", (F.col("attempt") + 1).alias("attempt"), (F.col("with_images") & (kind != "without_images")).alias("with_images"))
        own = again
        if stopped or not again.limit(1).count():
            break
    answers = done[0] if done else None
    for d in done[1:]:
        answers = answers.unionByName(d)
    if answers is None:
        answers = spark.createDataFrame([], "call_id string, text string, attempt int, with_images boolean")
    unasked = None
    if stopped:  # sent in no wave, or left over by one
        unasked = calls.join(answers, "call_id", "left_anti").select("call_id")
    return by_product(calls, answers, unasked, rounds)


def by_product(calls: DataFrame, answers: DataFrame, unasked: DataFrame | None, rounds: int) -> DataFrame:
    """The judgments of all products: of an index the last answer counts; a missing or unknown one is a failed judgment."""
    each = calls.select("call_id", F.explode("items").alias("i")).select("call_id", "i.item", "i.product_id")
    read = answers.select("call_id", "attempt", "with_images", answer_list(F.col("text")).alias("list"))
    flat = read.select("call_id", "attempt", "with_images", F.posexplode("list").alias("place", "a")).select("call_id", F.col("a.index").alias("item"), "place", "a.label", "a.reasoning")
    last = flat.filter("item IS NOT NULL").groupBy("call_id", "item").agg(F.max_by(F.struct("label", "reasoning"), "place").alias("a"))
    rows = each.join(read.select("call_id", "attempt", "with_images"), "call_id", "left").join(last, ["call_id", "item"], "left")
    if unasked is not None:
        rows = rows.join(unasked.withColumn("aborted", F.lit(True)), "call_id", "left")
    else:
        rows = rows.withColumn("aborted", F.lit(False))
    label = canonical_label(F.col("a.label"))
    status = F.when(F.coalesce("aborted", F.lit(False)), "aborted").when(label.isNull(), "failed").otherwise("ok")
    return rows.select(
        "call_id",
        "product_id",
        "item",
        F.coalesce(label, F.lit("Irrelevant")).alias("label"),
        F.when(label.isNotNull(), F.coalesce("a.reasoning", F.lit(""))).otherwise(FAILED).alias("reasoning"),
        label.isNull().alias("failed"),
        F.coalesce("attempt", F.lit(rounds)).alias("attempts"),
        F.coalesce("with_images", F.lit(False)).alias("with_images"),
        status.alias("status"),
    )


def forget_run(spark: SparkSession, folder: str) -> None:
    """Delete the waves of a run whose judgments are stored."""
    delete(spark, folder)


# functions go to the executors by value, which need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
