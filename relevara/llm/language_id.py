"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built; a text is parsed from left to
right into longest matches with it, and phrases * log2(training length) / text length estimates
the cross entropy.  The language that needs the fewest normalised phrases wins.

The automata of all languages are one dense transition table, and texts are parsed in blocks
that advance together, so that each step is a few numpy operations over thousands of blocks.
Each block is first parsed as if a phrase began with it; then the parse of the block before it
goes on into it until both begin a phrase at the same place, from where they agree, and the phrases
up to there are exchanged.  The sum is that of one parse of the whole text.

Training reads a bounded sample (arguments ``rows`` and ``symbols``): of the labelled rows per
language with the smallest hashes of their ids those whole texts, in that order, that fit
together; where none fits, what fits of the shortest one.  Texts of more than ``LONGEST`` bytes are sampled only
of a language that has no others.  All automata together hold at most ``ALL_SYMBOLS`` symbols, whatever the number of labels: with
more than 16 labels each gets its part.  Every text is scored whole, and by itself: neither its neighbours
nor the partitioning matter.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text
if nothing is labelled; ties go to the language first in code point order; repeated rows are
scored alike; a null label is no training row; a null doc_id counts as the empty text where the sample is
drawn; extra columns are not read unless kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevara.llm.common import checked, released, ship, text_session, written
from relevara.llm.textvec import buffers, pieces

#: Bounds of the training sample of each language.
ROWS, SYMBOLS = 256, 1 << 16
#: Symbols of all languages together, by which the table of transitions is bounded (about 2 states a symbol and
#: 4 bytes an entry: 0.5 GB with an alphabet of 64), and bytes of a text that is sampled where a language has shorter ones.
ALL_SYMBOLS, LONGEST = 1 << 20, 1 << 18
#: Symbols of a block of the parse.
BLOCK = 512
#: Bits of evidence that count as one natural unit in the score.
SOFTNESS = 16.0

#: Bytes as symbols: a-z in lower case, bytes of other letters as they are, all else one gap.
FOLD = np.zeros(256, np.uint8)
FOLD[ord("a") : ord("z") + 1] = FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
FOLD[0x80:] = np.arange(0x80, 0x100)
#: Second byte of the capital letters U+00C0 to U+00DE after 0xC3, which lie 0x20 below the small ones.
CAPITAL = np.arange(256, dtype=np.uint8)
CAPITAL[0x80:0x9F] += 0x20


def symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all texts, runs of gaps as one, and the offsets."""
    s = FOLD[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    s[lead] = CAPITAL[s[lead]]
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    first = off[:-1][off[:-1] < len(s)]
    keep[first] = s[first] != 0  # whatever the text before ends in
    before = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], before[off]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in text:
        cur = len(edges)
        edges.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                twin = len(edges)
                edges.append(edges[q].copy())
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return edges


def automaton_frame(x: pd.DataFrame, most: int) -> pd.DataFrame:
    """One language's automaton from its sample: (lang, n_symbols, n_states, edges) with edges as state, byte, state."""
    x = x.sort_values(["order", "text"])
    texts = pa.array(x["text"], pa.large_string())
    s, off = symbols(*buffers(texts))
    parts, used, size = [], 0, np.diff(off)
    alone = size.min() >= most
    for i in [int(size.argmin())] if alone else range(len(size)):
        if alone or used + size[i] < most:
            parts += [s[off[i] : off[i + 1]][: most - 1].tobytes(), b"\0"]
            used += len(parts[-2]) + 1
    edges = suffix_automaton(b"".join(parts))
    flat = np.array([(i, c, j) for i, e in enumerate(edges) for c, j in e.items()], np.int32)
    return pd.DataFrame({"lang": [x["lang"].iloc[0]], "n_symbols": [used], "n_states": [len(edges)], "edges": [flat.tobytes()]})


class Parser:
    """Phrases of texts under all languages at once."""

    def __init__(self, models: list[tuple[str, int, int, bytes]]) -> None:
        models = sorted(models)
        self.langs = [m[0] for m in models]
        self.bits = np.array([np.log2(max(m[1], 2)) for m in models])
        flat = [np.frombuffer(m[3], np.int32).reshape(-1, 3) for m in models]
        used = np.unique(np.concatenate([f[:, 1] for f in flat])) if flat else np.zeros(0, np.int32)
        self.code = np.full(256, len(used), np.uint8)  # bytes that no sample has: no match
        self.code[used] = np.arange(len(used))
        self.width = len(used) + 1
        self.root = np.concatenate([[0], np.cumsum([m[2] for m in models])])[:-1].astype(np.int32)
        table = np.full((sum(m[2] for m in models), self.width), -1, np.int32)
        for f, r in zip(flat, self.root, strict=True):
            table[f[:, 0] + r, self.code[f[:, 1]]] = (f[:, 2] + r) * self.width  # a state is kept as the place of its row
        self.table = table.ravel()
        self.root *= self.width
        starts = self.table.reshape(-1, self.width)[self.root // self.width] if len(models) else np.zeros((0, self.width), np.int32)
        # after a miss the symbol opens a new phrase, or is one by itself
        self.fresh = np.where(starts >= 0, starts, self.root[:, None]).astype(np.int32)

    def step(self, state: np.ndarray, root: np.ndarray, fresh: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state, and whether a phrase begins here: at the start, after a symbol that nothing matches, or where a match ends."""
        nxt = self.table[state + sym]
        miss = nxt < 0
        return np.where(miss, fresh, nxt), miss | (state == root)

    def phrases(self, s: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Number of phrases of each text (rows) under each language (columns)."""
        n, k, coded = len(off) - 1, len(self.langs), self.code[s]
        size = np.diff(off)
        blocks = (size + BLOCK - 1) // BLOCK
        own = np.repeat(np.arange(n), blocks)
        out = np.zeros((n, k))
        if len(own):
            nth = np.arange(len(own)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            start, length = off[:-1][own] + nth * BLOCK, np.minimum(size[own] - nth * BLOCK, BLOCK)
            for j in range(k):
                out[:, j] = np.bincount(own, self.block_phrases(j, coded, own, start, length), n)
        return out

    def block_phrases(self, j: int, coded: np.ndarray, own: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What each block adds to its text's phrases under language j."""
        root, fresh, m = self.root[j], self.fresh[j], len(own)
        order = np.argsort(-length, kind="stable")
        alive = m - np.searchsorted(length[order][::-1], np.arange(1, int(length.max()) + 1), "left")
        begins = np.zeros((BLOCK, m), bool)
        state, first = np.full(m, root), start[order]
        for i, a in enumerate(alive):
            sym = coded[first[:a] + i]
            state[:a], begins[i, :a] = self.step(state[:a], root, fresh[sym], sym)
        back = np.argsort(order)
        begins, final = begins[:, back], state[back]
        count = begins.sum(0).astype(np.int64)
        counted = np.ones(m, bool)
        lane = np.flatnonzero(own[1:] == own[:-1])  # blocks whose parse goes on into the next one
        agreed, state, add = self.carry(coded, begins, start, length, lane + 1, final[lane], root, fresh)
        count[lane] += add
        lane, state = lane[~agreed], state[~agreed]
        reach = lane + 1
        while len(lane):
            # of each text, the first of these is a part of the parse; it covers whole blocks up to where it agrees
            _, at = np.unique(own[lane], return_index=True)
            counted[reach[at]] = False
            covered = np.full(int(own[-1]) + 1, -1)
            covered[own[lane[at]]] = reach[at]
            goes = np.zeros(len(lane), bool)
            goes[at] = (reach[at] + 1 < m) & (own[np.minimum(reach[at] + 1, m - 1)] == own[lane[at]])
            agreed, now, add = self.carry(coded, begins, start, length, reach[goes] + 1, state[goes], root, fresh)
            count[lane[goes]] += add
            reach[goes] += 1
            state[goes] = now
            goes[goes] = ~agreed
            covered[own[lane[goes]]] = reach[goes]
            keep = goes | (lane > covered[own[lane]])
            lane, reach, state = lane[keep], reach[keep], state[keep]
        return np.where(counted, count, 0)

    def carry(self, coded: np.ndarray, begins: np.ndarray, start: np.ndarray, length: np.ndarray, target: np.ndarray, state: np.ndarray, root: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Goes on from ``state`` into the block ``target``: whether the parses agree in it, the state, the phrases gained.

        Where they agree, the block's own phrases up to there are taken off.
        """
        state, agreed = state.copy(), np.zeros(len(target), bool)
        mine, theirs = np.zeros(len(target), np.int64), np.zeros(len(target), np.int64)
        live = np.arange(len(target))
        for i in range(BLOCK):
            live = live[length[target[live]] > i]
            if not len(live):
                break
            t = target[live]
            sym = coded[start[t] + i]
            state[live], new = self.step(state[live], root, fresh[sym], sym)
            old = begins[i, t]
            both = new & old
            mine[live] += new & ~both
            theirs[live] += old & ~both
            agreed[live[both]] = True
            live = live[~both]
        return agreed, state, np.where(agreed, mine - theirs, mine)

    def predict(self, s: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) of each text."""
        if not self.langs:
            return np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1)
        bits = self.phrases(s, off) * self.bits
        best = bits.argmin(1)
        gap = (bits - bits[np.arange(len(best)), best][:, None]) / SOFTNESS
        return best, 1 / np.exp(-np.minimum(gap, 700)).sum(1)


def parser_of(shared: Broadcast) -> Parser:
    """The table of a broadcast's automata, made once per Python worker and kept with the broadcast."""
    kept = shared.value
    if kept[-1] is None:
        kept[-1] = Parser(kept[0])
    return kept[-1]


def predict_batches(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """The batch's other columns with lang_pred and score in place of text (the last column)."""
    parser = parser_of(shared)
    for whole in batches:
        last = whole.num_columns - 1
        for batch in pieces(whole, last, 1 << 22):
            best, score = parser.predict(*symbols(*buffers(batch.column(last))))
            named = batch.column(last - 1).to_numpy(zero_copy_only=False).astype(bool)  # whether it has a letter
            names = np.array([*parser.langs, "und"], object)
            pred = names[np.where(named & bool(parser.langs), best, -1)]
            score = np.where(pred == "und", 0.0, score)
            yield pa.RecordBatch.from_arrays([*batch.columns[: last - 1], pa.array(pred, pa.string()), pa.array(score)], names=[*batch.schema.names[: last - 1], "lang_pred", "score"])


def sample(spark: SparkSession, docs: DataFrame, use: Column, rows: int) -> DataFrame:
    """(lang, order, text) of at most ``rows`` labelled rows per language, by the hash of their ids."""
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    size = F.octet_length("text")
    long = F.when(size > LONGEST, size).otherwise(0)
    labelled = docs.filter(use & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("sample_lang"), order.alias("order"), long.alias("long"))
    first = Window.partitionBy("sample_lang").orderBy("long", "order", "sample_id")
    # one long text stands for a language that has no others
    ids = written(spark, labelled.withColumn("rn", F.row_number().over(first)).filter((F.col("rn") <= rows) & ((F.col("long") == 0) | (F.col("rn") == 1))).select("sample_id", "sample_lang", "order").distinct())
    texts = docs.select("doc_id", "lang", "text").join(checked(ids), F.col("doc_id").eqNullSafe(F.col("sample_id")) & (F.col("lang") == F.col("sample_lang")))
    return texts.filter(F.col("text").isNotNull()).select("lang", "order", "text").distinct()


def train(spark: SparkSession, docs: DataFrame, use: Column, rows: int = ROWS, most: int = SYMBOLS) -> list[tuple[str, int, int, bytes]]:
    """(language, training symbols, states, edges) of each language; a few MB each by the sample's bounds."""
    picked = written(spark, sample(spark, docs, use, rows))
    most = min(most, max(2, ALL_SYMBOLS // max(1, picked.select("lang").distinct().count())))
    models = picked.groupBy("lang").applyInPandas(lambda x: automaton_frame(x, most), "lang string, n_symbols long, n_states long, edges binary")
    return [(r["lang"], r["n_symbols"], r["n_states"], bytes(r["edges"])) for r in models.collect()]


def identify(spark: SparkSession, docs: DataFrame, use: Column, keep: list[str] | None = None, rows: int = ROWS, symbols: int = SYMBOLS) -> DataFrame:
    """``keep`` columns of every document with lang_pred and score, learning from rows where ``use`` holds.

    Names that the result adds must not be among ``keep``; ``rows`` and ``symbols`` bound the training
    sample of each language.
    """
    text_session(spark)
    models = spark.sparkContext.broadcast([train(spark, docs, use, rows, symbols), None])
    keep = ["doc_id"] if keep is None else keep
    flat = docs.select(*keep, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter"), "text")
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "lang_pred string", "score double"])
    return flat.mapInArrow(lambda it: released(predict_batches(it, models)), schema)


ship(__name__)
