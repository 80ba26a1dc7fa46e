"""Language-model scoring by a hashed maximum-entropy model.

log P(word | history) = log P(class | history) + log P(word | class, history).  The class of a word
comes from its last two bytes.  P(class | history) is a softmax over hashed features of the history:
the last word, the last two words (n-grams), the word before the last and the one before that
(skips).  P(word | class, history) is a hierarchical softmax over the candidates of the class, its
words among the ``CANDIDATES`` most frequent ones of the corpus, and one place for all its other words:
a Huffman tree by counts, each decision a logistic model of the same four features, hashed
together with the node, on top of the node's log odds in the counts.  The other words of a class
share their place in proportion to their counts plus one, with one share for the unknown.  Both
tables grow with the number of training tokens, the softmax's up to ``BUCKETS`` rows, that of the
decisions up to 2^``TREE_BITS`` entries.

Counting covers every training document.  The softmax is trained by rounds of distributed
gradient updates, and the trees with it: the training documents are dealt to the rounds by hash,
each task takes gradient steps over its documents from the common weights, and the changes are
averaged (those of the trees by the uses of each weight), block of weights by block, in two levels.
Scoring is sparse numpy over batches: four table rows per token, four entries per decision.

Words are told apart by a 64-bit hash alone.

Defined cases: a null text counts as empty and scores its end alone; a null doc_id is hashed as
the empty text; repeated rows score alike; without training documents every word is unknown;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relevara.llm.common import ship, text_session, written
from relevara.llm.textvec import buffers, mix, pieces, word_hashes

#: Classes (0: the end of a text), rounds of updates, tokens of a gradient step.
CLASSES, PASSES, STEP = 32, 2, 1 << 15
#: Least and most feature buckets of the softmax, and tokens per bucket.
LEAST_BUCKETS, BUCKETS, TOKENS_PER_BUCKET = 1 << 13, 1 << 16, 1 << 12
#: Words with places of their own in the trees, the most frequent ones.
CANDIDATES = 1 << 13
#: Words, the most frequent ones, whose counts go to every task; the counts of all others are joined.
COMMON_WORDS = 1 << 18
#: Weights that travel together, and the rate of a step.
SPAN, RATE = 1 << 14, 0.5
#: Least and most bits of the decisions' table, tokens per entry, their rate.
LEAST_BITS, TREE_BITS, TOKENS_PER_ENTRY, TREE_RATE = 16, 22, 64, 1.0
#: Training tasks that always run, and tokens per task beyond them.
TASKS, TASK_TOKENS = 6, 1 << 23
_NODE, _SLOT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9FB21C651E98DF25)
END = np.uint64(0x9E3779B97F4A7C15)
FEATURES = 4
_KEYS = mix(np.arange(1, 3 * FEATURES + 1, dtype=np.uint64))


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and classes of all tokens, each text closed by its end, and the offsets of the texts."""
    words, cut, _, tail = word_hashes(*buffers(col))
    n = len(cut) - 1
    off = cut + np.arange(n + 1)
    out, cls = np.full(int(off[-1]), END), np.zeros(int(off[-1]), np.int32)
    at = np.arange(len(words)) + np.repeat(np.arange(n), np.diff(cut))
    out[at] = words
    cls[at] = (mix(tail.astype(np.uint64) + np.uint64(77)) % np.uint64(CLASSES - 1)).astype(np.int32) + 1
    return out, cls, off


def histories(words: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hashes of the four features of each token; before a text's start stands 0."""
    n = len(words)
    place = np.arange(n) - np.repeat(off[:-1], np.diff(off))
    w = [np.where(place >= k, np.roll(words, k), np.uint64(0)) for k in (1, 2, 3)]
    keyed = [w[0] * _KEYS[0] ^ _KEYS[1], w[0] * _KEYS[2] + w[1] * _KEYS[3], w[1] * _KEYS[4] ^ _KEYS[5], w[2] * _KEYS[6] ^ _KEYS[7]]
    return np.stack([mix(x) for x in keyed])


def features(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the four features of each token."""
    mask = np.uint64(buckets // FEATURES - 1)
    return np.stack([(x & mask).astype(np.int32) + i * (buckets // FEATURES) for i, x in enumerate(hashes)])


def native(table: np.ndarray) -> np.ndarray:
    """A copy whose dtype is numpy's own object.

    Arrays that were sent have an equal dtype but another object, and ``np.add.at`` then takes ten times as long or more.
    """
    out = np.empty(table.shape, np.float32)
    out[...] = table
    return out


class Places:
    """Places of hashes among sorted keys, from the first key of their leading bits on."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(1, len(keys).bit_length())
        self.shift, self.n = np.uint64(64 - bits), len(keys)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.keys = np.append(keys, np.uint64(2**64 - 1))

    def __call__(self, words: np.ndarray) -> np.ndarray:
        """-1 for words that are no keys."""
        at = self.first.take((words >> self.shift).view(np.int64))
        behind = np.flatnonzero(self.keys.take(at) < words)
        for _ in range(16):
            at[behind] += 1
            behind = behind[self.keys.take(at[behind]) < words[behind]]
        at[behind] = np.searchsorted(self.keys, words[behind])
        at[(at == self.n) | (self.keys.take(at) != words)] = -1
        return at


class Trees:
    """The Huffman trees of all classes, as the decisions on the way to each symbol.

    Symbols are the candidates, by their hashes, then the place of all other words of each class.
    """

    def __init__(self, keys: np.ndarray, cls: np.ndarray, counts: np.ndarray, rest: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.places = keys[order], Places(keys[order])
        owner, mass = np.concatenate([cls[order], np.arange(CLASSES)]), np.concatenate([counts[order].astype(float), rest])
        ways: list[list[tuple[int, bool]]] = [[] for _ in owner]
        odds: list[float] = []
        for c in range(CLASSES):
            heap = [(float(mass[i]), int(i), [int(i)]) for i in np.flatnonzero(owner == c)]
            heapq.heapify(heap)
            while len(heap) > 1:
                (m0, i0, low), (m1, _, high) = heapq.heappop(heap), heapq.heappop(heap)
                for right, part in enumerate((low, high)):
                    for i in part:
                        ways[i].append((len(odds), bool(right)))
                odds.append(float(np.log(m1 / m0)))
                heapq.heappush(heap, (m0 + m1, i0, low + high))
        self.ends = np.concatenate([[0], np.cumsum([len(w) for w in ways])]).astype(np.int64)
        self.node = np.array([x for w in ways for x, _ in w], np.int32)
        self.right = np.array([x for w in ways for _, x in w], np.float32)
        self.odds = np.array(odds, np.float32)

    def symbols(self, words: np.ndarray, cls: np.ndarray) -> np.ndarray:
        at = self.places(words).astype(np.int64)
        return np.where(at >= 0, at, len(self.keys) + cls)

    def decisions(self, symbols: np.ndarray, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Token, direction, odds and four table entries of each decision on the ways to the symbols."""
        size = self.ends[symbols + 1] - self.ends[symbols]
        token = np.repeat(np.arange(len(symbols)), size)
        at = np.arange(len(token)) + np.repeat(self.ends[symbols] - (np.cumsum(size) - size), size)
        node = self.node[at]
        key = (node.astype(np.uint64) + np.uint64(1)) * _NODE
        key ^= key >> np.uint64(29)
        slots = [(((h[token] ^ key) * _SLOT) >> np.uint64(64 - bits)).view(np.int64) for h in hashes]
        return token, self.right[at], self.odds[node], slots


def tree_logs(trees: Trees, tree: np.ndarray, symbols: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """log P(symbol | class, history) of each token."""
    token, right, base, slots = trees.decisions(symbols, hashes, len(tree).bit_length() - 1)
    s = np.clip(base + sum(tree.take(x) for x in slots), -60, 60)
    return -np.bincount(token, np.log1p(np.exp((1 - 2 * right) * s)), len(symbols))


def tree_step(trees: Trees, tree: np.ndarray, used: np.ndarray, symbols: np.ndarray, hashes: np.ndarray) -> None:
    """Moves the entries that occur by TREE_RATE times their mean residual, damped for rare ones; adds up their uses."""
    _, right, base, slots = trees.decisions(symbols, hashes, len(tree).bit_length() - 1)
    res = right - 1 / (1 + np.exp(-np.clip(base + sum(tree.take(x) for x in slots), -60, 60)))
    at, n = np.concatenate(slots), np.zeros(len(tree), np.float32)
    np.add.at(n, at, np.float32(1))
    np.add.at(tree, at, np.tile(np.float32(TREE_RATE) * res.astype(np.float32), len(slots)) / (n.take(at) + 2))
    used += n


def logits(weights: np.ndarray, bias: np.ndarray, f: np.ndarray) -> np.ndarray:
    s = weights.take(f[0], 0)
    s += bias
    for x in f[1:]:
        s += weights.take(x, 0)
    s -= s.max(1, keepdims=True)
    return s


def log_softmax(weights: np.ndarray, bias: np.ndarray, f: np.ndarray) -> np.ndarray:
    s = logits(weights, bias, f)
    s -= np.log(np.exp(s).sum(1, keepdims=True))
    return s


def gradient_step(weights: np.ndarray, bias: np.ndarray, f: np.ndarray, cls: np.ndarray) -> None:
    """Moves the weights of the features that occur by RATE times their mean residual, damped for rare ones."""
    f = f.astype(np.int64)
    res = logits(weights, bias, f)
    np.exp(res, out=res)
    res /= -res.sum(1, keepdims=True)
    res[np.arange(len(cls)), cls] += 1
    # two classes are added at once, as the parts of a complex number
    pairs, columns, each = weights.reshape(-1).view(np.complex64), np.arange(CLASSES // 2), np.empty_like(res)
    for x in f:
        np.multiply(res, (RATE / (np.bincount(x, minlength=len(weights))[x] + 2.0)).astype(np.float32)[:, None], out=each)
        np.add.at(pairs, (x[:, None] * (CLASSES // 2) + columns).ravel(), each.reshape(-1).view(np.complex64))


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, cls, n) of the training texts, added up over a few million tokens."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        words, cls = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        w, first, n = np.unique(words, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(cls[first]), pa.array(n)], names=["word", "cls", "n"])

    for whole in batches:
        for batch in pieces(whole, 0, 1 << 21):
            held.append(tokens(batch.column(0))[:2])
            if sum(len(x) for x, _ in held) > 3_000_000:
                yield out()
    if held:
        yield out()


def update_batches(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: np.ndarray, tree: np.ndarray, trees: Trees) -> Iterator[pa.RecordBatch]:
    """(block, part, n_tokens, change) after this task's gradient steps: the softmax's, the trees', the uses of the trees'."""
    new, grown, used, seen = native(weights), native(tree), np.zeros(len(tree), np.float32), 0
    for whole in batches:
        for batch in pieces(whole, 0):
            words, cls, off = tokens(batch.column(0))
            h, symbols = histories(words, off), trees.symbols(words, cls)
            f = features(h, len(weights))
            for i in range(0, len(words), STEP):
                gradient_step(new, bias, f[:, i : i + STEP], cls[i : i + STEP])
                tree_step(trees, grown, used, symbols[i : i + STEP], h[:, i : i + STEP])
            seen += len(words)
    if seen:
        change = np.concatenate([((new - weights).astype(np.float64) * seen).astype(np.float32).ravel(), (grown - tree) * used, used])
        blocks = range(0, len(change), SPAN)
        part = TaskContext.get().partitionId()
        cols = [pa.array([i // SPAN for i in blocks], pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array([seen] * len(blocks), pa.int64()), pa.array([change[i : i + SPAN].tobytes() for i in blocks], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["block", "part", "n", "change"])


def summed(x: pd.DataFrame) -> pd.DataFrame:
    x = x.sort_values("part")
    total = np.sum([np.frombuffer(c, np.float32) for c in x["change"]], axis=0, dtype=np.float64).astype(np.float32)
    return pd.DataFrame({"block": x["block"].iloc[:1], "part": x["part"].iloc[:1], "n": [x["n"].sum()], "change": [total.tobytes()]})


def power(least: int, most: int, n: int) -> int:
    """The smallest power of two from ``least`` on that is over ``n``, at most ``most``."""
    return min(most, max(least, 1 << n.bit_length()))


def train(spark: SparkSession, texts: DataFrame, bias: np.ndarray, trees: Trees, n_tokens: int, key: Column, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Weights of softmax and trees after ``passes`` averaged updates; together they read every training text once."""
    weights = np.zeros((power(LEAST_BUCKETS, BUCKETS, n_tokens // TOKENS_PER_BUCKET), CLASSES), np.float32)
    tree = np.zeros(power(1 << LEAST_BITS, 1 << TREE_BITS, n_tokens // TOKENS_PER_ENTRY), np.float32)
    for k in range(passes):
        shared = spark.sparkContext.broadcast((weights, bias, tree, trees))
        own = texts.filter(F.pmod(key, F.lit(passes)) == k).select("text")
        schema = "block int, part int, n long, change binary"
        own = own.coalesce(max(TASKS, n_tokens // passes // TASK_TOKENS))
        changes = own.mapInArrow(lambda it, b=shared: update_batches(it, *b.value), schema)
        near = changes.groupBy("block", F.pmod("part", F.lit(max(1, int(changes.rdd.getNumPartitions() ** 0.5)))).alias("salt")).applyInPandas(summed, schema)
        rows = near.groupBy("block").applyInPandas(summed, schema).orderBy("block").collect()
        if rows:
            total = np.concatenate([np.frombuffer(r["change"], np.float32) for r in rows])
            flat, grown, used = np.split(total, [weights.size, weights.size + len(tree)])
            weights = weights + flat.reshape(weights.shape) / np.float32(max(r["n"] for r in rows))
            tree = tree + grown / np.maximum(used, 1)
        shared.unpersist()
    return weights, tree


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words above the lowest count that at most ``most`` words exceed, sorted, their counts and classes."""
    sizes = sorted(((r["n"], r["v"]) for r in counts.groupBy("n").agg(F.count("*").alias("v")).filter("n > 1").collect()), reverse=True)
    above, low = 0, None
    for n, v in sizes:
        if above + v > most:
            break
        above, low = above + v, n
    if low is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    table = counts.filter(F.col("n") >= low).select("word", "n", "cls").toArrow()
    keys, values, cls = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy(), table.column(2).to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order], cls[order]


SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>"


def score_batches(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    """Per text (doc_id, held_out, text) a row of SCORED; the words whose counts are not at hand are listed in ``rare``."""
    weights, bias, share, places, values, tree, trees = (model[k] for k in ("weights", "bias", "share", "places", "counts", "tree", "trees"))
    base, uid = np.log10(float(model["n"] + model["v"] + 1)), TaskContext.get().partitionId() << 40
    for whole in batches:
        for batch in pieces(whole, 2):
            words, cls, off = tokens(batch.column(2))
            h, symbols, n = histories(words, off), trees.symbols(words, cls), np.diff(off)
            f = features(h, len(weights))
            logs = np.zeros(len(words))
            for i in range(0, len(words), STEP):
                part = slice(i, i + STEP)
                logs[part] = log_softmax(weights, bias, f[:, part])[np.arange(len(cls[part])), cls[part]] + tree_logs(trees, tree, symbols[part], h[:, part])
            at, c = places(words), np.zeros(len(words), np.int64)
            here, other = at >= 0, symbols >= len(trees.keys)
            c[here] = values[at[here]]
            own = np.log10(c + 1.0)
            score = np.add.reduceat(logs / np.log(10.0) + np.where(other, own - share[cls], 0.0), off[:-1])
            known = np.add.reduceat(here.astype(np.int64), off[:-1])
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n - known)]).astype(np.int32)), pa.array(words[~here].view(np.int64)))
            ids = np.arange(uid, uid + len(n))
            uid += len(n)
            cols = [pa.array(ids), batch.column(0), batch.column(1), pa.array(n), pa.array(known), pa.array(np.add.reduceat(own, off[:-1]) - n * base), pa.array(score), rare]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCORED.split(", ")])


def maxent_scores(spark: SparkSession, docs: DataFrame, held_out: Column, common_words: int = COMMON_WORDS, candidates: int = CANDIDATES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` is the add-one unigram's log10 probability and ``score`` the model's.
    """
    text_session(spark)
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    training = flat.filter("NOT held_out")
    counts = training.select("text").mapInArrow(count_batches, "word long, cls int, n long")
    counts = written(spark, counts.groupBy("word").agg(F.min("cls").alias("cls"), F.sum("n").alias("n")))
    per = {r["cls"]: (r["n"], r["v"]) for r in counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    n, v = (np.array([per.get(c, (0, 0))[i] for c in range(CLASSES)], np.float64) for i in range(2))
    bias = np.log((n + 1) / (n.sum() + CLASSES)).astype(np.float32)
    words, known, cls = frequent(counts, common_words)
    top = np.lexsort((words, -known))[:candidates]
    # what is left of each class: tokens plus words plus the unknown
    rest = n + v + 1 - np.bincount(cls[top], known[top] + 1.0, CLASSES)
    trees = Trees(words[top], cls[top], known[top], rest)
    weights, tree = train(spark, training, bias, trees, int(n.sum()), F.xxhash64("doc_id", F.length("text")))
    model = {"weights": weights, "tree": tree, "trees": trees, "bias": bias, "share": np.log10(rest), "n": int(n.sum()), "v": int(v.sum()), "places": Places(words), "counts": known}
    shared = spark.sparkContext.broadcast(model)
    scored = written(spark, flat.mapInArrow(lambda it: score_batches(it, shared.value), SCORED))
    # the counts of all other words come by a join
    others = counts.filter(F.col("n") < int(known.min())) if len(known) else counts
    rare = scored.select("uid", F.explode("rare").alias("word")).groupBy("uid", "word").agg(F.count("*").alias("times")).join(others.select("word", "n"), "word")
    found = rare.groupBy("uid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("add"))
    add = F.coalesce("add", F.lit(0.0))
    return scored.drop("rare").join(found, "uid", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(model["n"]).cast("long").alias("train_tokens"), (F.col("base_score") + add).alias("base_score"), (F.col("score") + add).alias("score"))


ship(__name__)
