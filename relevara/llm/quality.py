"""Quality classification by a weak-label model.

Overlapping heuristic labellers vote good, bad or nothing on each text.  Expectation-maximisation
over the counts of vote patterns, a table of bounded size whatever the corpus, estimates the
accuracy of each labeller; the posterior of a pattern is the weak label of its documents.  Soft
labels then train a linear scorer over hashed words by rounds of distributed gradient updates,
and the score of a document is the scorer's probability that it is good.

Patterns and labels cover all documents; the scorer is fitted on a bounded sample, the
``FIT_ROWS`` documents with the smallest hashes of id and text, whole texts.

Defined cases: a null text counts as empty and scores 0; so does a text without words; repeated
rows score alike; a null doc_id keeps its row; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevara.llm.common import checked, ship, text_session, written
from relevara.llm.textvec import SPACE, buffers, pieces, sums, word_hashes

#: Rows that fit the scorer, hash buckets, rounds of updates and their rate.
FIT_ROWS, BUCKETS, PASSES, RATE = 20_000, 1 << 16, 30, 8.0
#: Parts of the sample, each a task that takes local steps; fixed, as the weights depend on it.
FIT_PARTS = 6
#: (low, high) of each heuristic: bad outside of it, good well inside of it, otherwise no vote.
HEURISTICS = {
    "letters": (0.70, 0.77, 0.90, 0.93),  # share of letters among all bytes
    "symbols": (-1.0, -1.0, 0.030, 0.060),  # share of other visible bytes
    "capitals": (-1.0, -1.0, 0.06, 0.15),  # share of capitals among letters
    "digits": (-1.0, -1.0, 0.01, 0.05),  # share of digits
    "word_size": (2.5, 3.5, 8.5, 11.0),  # mean bytes of a word
    "distinct": (0.20, 0.40, 1.0, 1.1),  # share of distinct words
    "closed": (0.001, 0.02, 0.35, 0.6),  # sentence ends per word
    "words": (8, 20, 1e9, 1e9),  # number of words
}
_CLASS = np.zeros(256, np.int8)
_CLASS[ord("a") : ord("z") + 1] = _CLASS[0x80:] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in ".?"]] = 4
_CLASS[[ord(c) for c in "!\"#$%&*+/:;<=>@[\\]^_`{|}~"]] = 5


def measures(data: np.ndarray, off: np.ndarray, words: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The heuristics' values of each text, in their order."""
    kind = _CLASS[data]
    n = {k: sums((kind == k).astype(np.int64), off) for k in (1, 2, 3, 4, 5)}
    size = np.maximum(sums((~SPACE[data]).astype(np.int64), off), 1)
    count = np.diff(cut)
    own = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((words, own))
    w, o = words[order], own[order]
    new = np.concatenate([[True], (w[1:] != w[:-1]) | (o[1:] != o[:-1])]) if len(w) else np.zeros(0, bool)
    distinct = np.bincount(o[new], minlength=len(count))
    total = np.maximum(count, 1)
    spread = np.minimum(1.0, distinct / np.maximum(1.0, total**0.85))  # long texts repeat words
    letters = n[1] + n[2]
    return np.stack([letters / size, n[5] / size, n[2] / np.maximum(letters, 1), n[3] / size, size / total, spread, n[4] / total, count.astype(float)], 1)


def votes(values: np.ndarray) -> np.ndarray:
    """0 bad, 1 good, 2 none, of each text and heuristic."""
    a, b, c, d = np.array(list(HEURISTICS.values())).T
    out = np.full(values.shape, 2, np.int8)
    out[(values >= b) & (values <= c)] = 1
    out[(values < a) | (values > d)] = 0
    return out


def profile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, order, pattern): a text's votes as a number to base 3; -1 without words."""
    for whole in batches:
        for batch in pieces(whole, 2):
            data, off = buffers(batch.column(2))
            words, cut, _, _ = word_hashes(data, off)
            v = votes(measures(data, off, words, cut)).astype(np.int64)
            pattern = np.where(np.diff(cut) > 0, v @ 3 ** np.arange(v.shape[1]), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pattern)], names=["doc_id", "order", "pattern"])


def accuracies(patterns: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each pattern, labellers' accuracies (class x labeller) and the share of good texts.

    Labellers err independently given the class, and abstain alike in both.
    """
    m = len(HEURISTICS)
    v = patterns[:, None] // 3 ** np.arange(m) % 3
    good, bad = v == 1, v == 0
    share = (good.sum(1) - 3 * bad.sum(1)) > 0  # one bad vote outweighs some good ones at the start
    post = np.where(share, 0.9, 0.1)
    for _ in range(rounds):
        prior = float(np.clip((post * n).sum() / max(n.sum(), 1), 0.02, 0.98))
        acc = np.empty((2, m))
        for c, p in ((1, post), (0, 1 - post)):
            right = ((good if c else bad) * (p * n)[:, None]).sum(0)
            acc[c] = (right + 2.0) / (((good | bad) * (p * n)[:, None]).sum(0) + 3.0)
        acc = np.clip(acc, 0.05, 0.98)
        up = (good * np.log(acc[1]) + bad * np.log(1 - acc[1])).sum(1) + np.log(prior)
        down = (bad * np.log(acc[0]) + good * np.log(1 - acc[0])).sum(1) + np.log(1 - prior)
        post = 1 / (1 + np.exp(np.clip(down - up, -50, 50)))
    return post, acc, prior


def design(batch_text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of texts (rows, buckets, values): shares of words, and bands of the measures."""
    data, off = buffers(batch_text)
    words, cut, _, _ = word_hashes(data, off)
    count = np.diff(cut)
    rows = np.repeat(np.arange(len(count)), count)
    half = BUCKETS - 512
    cols = (words % np.uint64(half)).astype(np.int64)
    values = 1.0 / np.maximum(np.repeat(count, count), 1)
    edges = [np.linspace(0, 1, 15)[1:] if hi <= 1.1 else np.geomspace(1, max(2.0, min(hi, 1e5)), 14) for _, _, _, hi in HEURISTICS.values()]
    m = measures(data, off, words, cut)
    for j, e in enumerate(edges):
        band = half + j * 32 + np.searchsorted(np.sqrt(e) if e[-1] <= 1.1 else e, np.sqrt(m[:, j]) if e[-1] <= 1.1 else m[:, j])
        rows, cols, values = np.append(rows, np.arange(len(count))), np.append(cols, band), np.append(values, np.full(len(count), 0.25))
    return rows, cols, values


def margins(weights: np.ndarray, x: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    return np.bincount(x[0], weights[x[1]] * x[2], n) + weights[-1]


def gradient_batches(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row of each task: the number of its texts and the sum of their gradients."""
    grad, seen, own = np.zeros(BUCKETS), 0, weights.copy()
    for whole in batches:
        for batch in pieces(whole, 1):
            x, n = design(batch.column(1)), batch.num_rows
            for _ in range(2):
                p = 1 / (1 + np.exp(-np.clip(margins(own, x, n), -30, 30)))
                res = batch.column(0).to_numpy() - p
                step = np.bincount(x[1], x[2] * res[x[0]], BUCKETS)
                step[-1] = res.sum() / 4
                own += RATE * step / max(n, 1) ** 0.5
            seen += n
    grad = (own - weights) * seen
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([grad.tobytes()], pa.binary())], names=["n", "grad"])


def added(x: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(g, np.float64) for g in sorted(x["grad"])], axis=0)  # the same sum whatever the order of rows
    return pd.DataFrame({"n": [x["n"].sum()], "grad": [total.tobytes()]})


def score_batches(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, 1):
            p = 1 / (1 + np.exp(-np.clip(margins(weights, design(batch.column(1)), batch.num_rows), -30, 30)))
            words = np.diff(word_hashes(*buffers(batch.column(1)))[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(words > 0, p, 0.0))], names=["doc_id", "score"])


def quality_scores(spark: SparkSession, docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), good (score of 0.5 or more)."""
    text_session(spark)
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), order.alias("order"), "text")
    rows = written(spark, flat.mapInArrow(profile_batches, "doc_id long, order long, pattern long"))
    table = rows.filter("pattern >= 0").groupBy("pattern").count().orderBy("pattern").collect()
    weights = np.zeros(BUCKETS)
    if table:
        patterns, n = np.array([r["pattern"] for r in table]), np.array([r["count"] for r in table], float)
        post, _, prior = accuracies(patterns, n)
        labels = spark.createDataFrame(pd.DataFrame({"pattern": patterns, "label": post}))
        # the sample: the rows with the smallest hashes, exactly fit_rows of them if there are so many; repeated rows count once
        distinct = rows.filter("pattern >= 0").groupBy("order").agg(F.min("pattern").alias("pattern"))
        first = distinct.orderBy("order").limit(fit_rows)
        chosen = written(spark, first.join(F.broadcast(labels), "pattern").select(F.col("order").alias("o"), "label"))
        side = checked(chosen)
        texts = flat.join(side, F.col("order") == F.col("o")).select("o", "label", "text")
        texts = written(spark, texts.dropDuplicates(["o"]).repartition(FIT_PARTS, "o").sortWithinPartitions("o").select("label", "text"))
        weights[-1] = np.log(prior / (1 - prior))
        for _ in range(PASSES):
            shared = spark.sparkContext.broadcast(weights)
            parts = texts.mapInArrow(lambda it, b=shared: gradient_batches(it, b.value), "n long, grad binary")
            total = parts.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(added, "n long, grad binary").first()
            if total is None or not total["n"]:
                break
            weights = weights + np.frombuffer(total["grad"]) / total["n"]
    shared = spark.sparkContext.broadcast(weights)
    scored = flat.select("doc_id", "text").mapInArrow(lambda it: score_batches(it, shared.value), "doc_id long, score double")
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).alias("good"))


ship(__name__)
