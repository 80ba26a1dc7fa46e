"""Collocations: phrases of two to four words that occur often, scored against the counts of their parts.

Words are counted per language first.  The frequent ones get numbers, and texts become runs of
numbers, broken at ends of pieces and at words that are not frequent, as no frequent phrase
holds those.  The runs are written once.  Phrases of two, three and four words are then counted one length
after the other: phrases are packed into keys of four bytes a word, equal keys of a task become one with
a count, and keys travel to the range that the leading bits of a mixed key name.  There they are
sorted by their 16-bit digits and counted by runs.  A longer phrase can be frequent only where the two
shorter ones it is made of are; a bitmap over their hashes, of bounded size, tells most of the others
before they travel, and the counts stay exact whatever it lets pass.

Parts of candidates are looked up in the table of all frequent phrases by joins.

The dictionary travels to all tasks if it has at most ``DICTIONARY`` words; a larger one is joined to the words
of the texts instead.  Long texts are taken in pieces of about ``CHUNK`` bytes, cut between words.

Defined cases: a null text is empty; a null lang is ``und``; repeated rows count each time; a
null doc_id doesn't matter, as ids are not read, nor are extra columns; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevara.llm.common import arrow_rows, checked, forget, ship, written
from relevara.llm.textvec import BYTE64, LOWER, buffers, mix, pieces, powers

#: Words of a dictionary that travels to all tasks: 16 bytes each.
DICTIONARY = 2_000_000
#: Bytes of text of one numpy step; words of a task's table and keys of a block, which are then passed on.
CHUNK, WORDS, KEYS = 2 << 20, 200_000, 1 << 19
#: Rows of an Arrow batch of texts, and of one of runs or keys, which are about a MB each.
TEXTS, BLOCKS = 512, 16
#: Keys of a range, and most ranges.
RANGE, MOST_RANGES = 1 << 20, 1 << 16
#: Bits of the bitmaps: 16 for each frequent phrase within these bounds, kept in segments.
LEAST_BITS, MOST_BITS, SEGMENT = 1 << 16, 1 << 28, 1 << 20
#: 1 for white space within a piece, 2 for what ends one.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
OTHER64 = mix(np.arange(501, 757, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def lang_key(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


class Words:
    """Words of a run of bytes: places, sizes, two hashes, and whether each begins a piece."""

    def __init__(self, data: np.ndarray, off: np.ndarray, goes_on: bool = False) -> None:
        kind = KIND[data]
        keep = kind == 0
        start = keep.copy()
        start[1:] &= ~keep[:-1]
        first = off[:-1][off[:-1] < len(data)]
        start[first] = keep[first]
        kept = np.flatnonzero(keep)
        low = LOWER[data[kept]]
        at = np.flatnonzero(start[kept])
        self.at = kept[at]
        self.size = np.diff(np.append(at, len(low)))
        if not len(at):
            self.one, self.two = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            self.text, self.new = np.zeros(0, np.int64), np.zeros(0, bool)
            return
        power = powers(int(self.size.max()))[np.arange(len(low)) - np.repeat(at, self.size)]
        size = self.size.astype(np.uint64) * _STEP
        self.one = np.add.reduceat(BYTE64[low] * power, at) + size
        self.two = mix(np.add.reduceat(OTHER64[low] * power, at) + size)
        self.text = np.searchsorted(off, self.at, "right") - 1
        ends = np.cumsum(kind == 2)[self.at]
        self.new = np.concatenate([[not goes_on or ends[0] > 0], (ends[1:] != ends[:-1]) | (self.text[1:] != self.text[:-1])])


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, bool]]:
    """(language of each text, bytes, offsets, whether it goes on from the run before); a long text is cut after words."""
    for whole in batches:
        for b in pieces(whole, 1, CHUNK):
            langs = ["und" if x is None else x for x in b.column(0).to_pylist()]
            data, off = buffers(b.column(1))
            at = 0
            while len(langs) == 1 and len(data) - at > 2 * CHUNK:
                i, step = at + CHUNK, 1 << 16
                while i < len(data):
                    word = KIND[data[i - 1 : i + step]] == 0
                    end = word[:-1] & ~word[1:]  # right after a word, so that what ends its piece comes with the next one
                    if end.any():
                        i += int(np.argmax(end))
                        break
                    i += step
                i = min(i, len(data))
                yield langs, data[at:i], np.array([0, i - at]), at > 0
                at = i
            yield langs, data[at:], off if not at else np.array([0, len(data) - at]), at > 0


def keyed(langs: list[str], w: Words) -> np.ndarray:
    """One hash of language and word."""
    return mix(w.one + np.array([lang_key(x) for x in langs], np.uint64)[w.text])


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of a task's words; the row without a word is the number of all words of the language."""
    table: dict[tuple[str, bytes | None], int] = {}
    for langs, data, off, _ in runs(batches):
        w = Words(data, off)
        key = keyed(langs, w)
        order = np.argsort(key)
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(order) else np.zeros(0, bool)
        if (~new[1:] & (w.two[order][1:] != w.two[order][:-1])).any():  # hashes that collide
            order = np.lexsort((w.two, key))
            new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (w.two[order][1:] != w.two[order][:-1])])
        starts = np.flatnonzero(new)
        low = LOWER[data].tobytes()
        for i, n in zip(order[starts].tolist(), np.diff(np.append(starts, len(order))).tolist(), strict=True):
            a = int(w.at[i])
            name = (langs[w.text[i]], low[a : a + int(w.size[i])])
            table[name] = table.get(name, 0) + n
        for i, n in enumerate(np.bincount(w.text, minlength=len(langs)).tolist()):
            if n:
                table[langs[i], None] = table.get((langs[i], None), 0) + n
        if len(table) > WORDS:
            yield word_rows(table)
            table = {}
    yield word_rows(table)


def word_rows(table: dict[tuple[str, bytes | None], int]) -> pa.RecordBatch:
    words = [None if w is None else w.decode() for _, w in table]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in table], pa.string()), pa.array(words, pa.string()), pa.array(list(table.values()), pa.int64())], names=["lang", "word", "n"])


class Dictionary:
    """Numbers of words by their hashes: a place for each value of the leading bits, from where equal ones are looked at."""

    def __init__(self, one: np.ndarray, two: np.ndarray, number: np.ndarray) -> None:
        order = np.argsort(one)
        self.one, self.two, self.number = one[order], two[order], number[order].astype(np.uint32)
        bits = max(1, int(len(one)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.one >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int64)

    def numbers(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for one that isn't here."""
        out = np.zeros(len(one), np.uint32)
        if not len(self.one):
            return out
        top = (one >> self.shift).astype(np.int64)
        at, end, live = self.first[top], self.first[top + 1], np.arange(len(one))
        while len(live):
            live = live[at[live] < end[live]]
            here = at[live]
            same = (self.one[here] == one[live]) & (self.two[here] == two[live])
            out[live[same]] = self.number[here[same]]
            live = live[~same & (self.one[here] <= one[live])]
            at[live] += 1
        return out


def dictionary_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, number) -> the two hashes, as numbers with signs, and the number."""
    for b in batches:
        data, off = buffers(b.column(1))
        w = Words(data, off)
        one = keyed(b.column(0).to_pylist(), w)
        yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(w.two.view(np.int64)), b.column(2)], names=["one", "two", "number"])


def joined_up(ids: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Numbers with a 0 where a piece begins; words without a frequent neighbour and further zeros are left out."""
    out = np.zeros(len(ids) + int(new.sum()), np.uint32)
    out[np.arange(len(ids)) + np.cumsum(new)] = ids
    if len(out):
        some = out != 0
        beside = np.zeros(len(out), bool)
        beside[1:] |= some[:-1]
        beside[:-1] |= some[1:]
        out[some & ~beside] = 0
        some = out != 0
        some[1:] |= out[:-1] != 0
        out = out[some]
    return out


def encoded_batches(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """Texts as runs of numbers, a row for some MB of text or for one long text."""
    dictionary: Dictionary = shared.value
    parts: list[np.ndarray] = []
    size = 0
    for langs, data, off, goes_on in runs(batches):
        if size > CHUNK and not goes_on:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(parts).tobytes()], pa.binary())], names=["ids"])
            parts, size = [], 0
        w = Words(data, off, goes_on)
        part = (dictionary.numbers(keyed(langs, w), w.two), w.new)
        if not goes_on:
            parts.append(np.zeros(1, np.uint32))
        # what is left out at an end may have a neighbour in the next part of a long text
        parts.append(joined_up(*part) if len(data) < CHUNK and not goes_on else whole_run(*part))
        size += len(parts[-1]) * 4
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(parts).tobytes()], pa.binary())], names=["ids"])


def whole_run(ids: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids) + int(new.sum()), np.uint32)
    out[np.arange(len(ids)) + np.cumsum(new)] = ids
    return out


def from_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [np.array([0 if x is None else x for x in ids], np.uint32).tobytes() for ids in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])


def joined_ids(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The runs of numbers by a join of all words with the dictionary, for one that is too large to travel."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = F.translate(F.coalesce("text", F.lit("")), upper, lower)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce("lang", F.lit("und")).alias("lang"), F.posexplode(F.split(low, r"[.,;:!?\n\x0B\f\r]")).alias("piece", "p"))
    words = texts.select("row", "lang", "piece", F.posexplode(F.split("p", r"[ \t]+")).alias("i", "word")).filter("word <> ''")
    found = words.join(dictionary.select("lang", "word", "number"), ["lang", "word"], "left")
    ends = words.groupBy("row", "piece").agg(F.lit(-1).alias("i")).select("row", "piece", "i", F.lit(0).alias("number"))
    every = found.select("row", "piece", "i", F.coalesce("number", F.lit(0)).alias("number")).unionByName(ends)
    lists = every.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("piece", "i", "number"))).alias("x"))  # one text
    return lists.select(F.concat(F.col("x.number"), F.array(F.lit(0))).alias("ids")).mapInArrow(from_arrays, "ids binary")


def phrase_keys(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where n words stand together, and their keys as two numbers: the first two words, and the others."""
    if len(ids) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    some = ids != 0
    whole = some[: len(ids) - n + 1].copy()
    for i in range(1, n):
        whole &= some[i : len(ids) - n + 1 + i]
    at = np.flatnonzero(whole)
    wide = lambda i: ids[at + i].astype(np.uint64)
    high = wide(0) << np.uint64(32) | wide(1)
    low = np.zeros(len(at), np.uint64)
    for i in range(2, n):
        low |= wide(i) << np.uint64(32 * (3 - i))
    return at, high, low


def mixed_key(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return mix(high ^ mix(low + _STEP))


def radix_order(digits: list[np.ndarray]) -> np.ndarray:
    """The order of keys of several 64-bit numbers, most significant first, by stable sorts of 16-bit digits."""
    order = np.arange(len(digits[0]))
    for number in reversed(digits):
        for shift in (0, 16, 32, 48):
            d = (number >> np.uint64(shift)).astype(np.uint16)
            if len(d) and (d != d[0]).any():
                order = order[np.argsort(d[order], kind="stable")]
    return order


def run_lengths(high: np.ndarray, low: np.ndarray, count: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys and their counts, in order."""
    order = radix_order([high, low])
    high, low = high[order], low[order]
    starts = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) if len(high) else np.zeros(0, np.int64)
    if count is None:
        total = np.diff(np.append(starts, len(high)))
    else:
        total = np.add.reduceat(count[order], starts) if len(starts) else count
    return high[starts], low[starts], total.astype(np.int64)


def packed(high: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
    """Keys of 4 * n bytes, the number of each word with its high byte first."""
    out = np.empty((len(high), 4), ">u4")
    out[:, 0], out[:, 1] = high >> np.uint64(32), high & np.uint64(0xFFFFFFFF)
    out[:, 2], out[:, 3] = low >> np.uint64(32), low & np.uint64(0xFFFFFFFF)
    return np.ascontiguousarray(out[:, :n])


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(data) // (4 * n), 4), np.uint64)
    x[:, :n] = np.frombuffer(data, ">u4").reshape(-1, n)
    return x[:, 0] << np.uint64(32) | x[:, 1], x[:, 2] << np.uint64(32) | x[:, 3]


def holds(bitmap: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    at = mixed_key(high, low) & np.uint64(len(bitmap) * 8 - 1)
    return bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) != 0


def key_batches(batches: Iterator[pa.RecordBatch], n: int, ranges: int, shared: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """Phrases of n words of a task as (range, keys, counts), a row for each range of a block."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for b in batches:
        for data in b.column(0).to_pylist():
            ids = np.frombuffer(data, np.uint32)
            at, high, low = phrase_keys(ids, n)
            if shared is not None:
                short, a, c = phrase_keys(ids, n - 1)
                good = np.zeros(len(ids) + 1, bool)
                good[short] = holds(shared.value, a, c)
                use = good[at] & good[at + 1]
                high, low = high[use], low[use]
            for i in range(0, len(high), KEYS):
                held.append((high[i : i + KEYS], low[i : i + KEYS]))
                size += len(held[-1][0])
                if size >= KEYS:
                    yield from block_rows(held, n, ranges)
                    held, size = [], 0
    if size:
        yield from block_rows(held, n, ranges)


def block_rows(held: list[tuple[np.ndarray, np.ndarray]], n: int, ranges: int) -> Iterator[pa.RecordBatch]:
    high, low, count = run_lengths(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), None)
    # the leading bits of the mixed key as a number below ``ranges``
    part = ((mixed_key(high, low) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    high, low, count, part = high[order], low[order], count[order], part[order]
    cut = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))
    for i in range(0, len(cut) - 1, 256):
        spans = list(zip(cut[i : i + 256], cut[i + 1 : i + 257], strict=False))
        keys = [packed(high[a:b], low[a:b], n).tobytes() for a, b in spans]
        counts = [count[a:b].astype("<u4").tobytes() for a, b in spans]
        yield pa.RecordBatch.from_arrays([pa.array([int(part[a]) for a, _ in spans], pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["part", "keys", "counts"])


def merged_batches(batches: Iterator[pa.RecordBatch], n: int, least: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range: the frequent phrases of each as (key, f)."""
    now, held, size = None, [], 0

    def compact() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return run_lengths(*(np.concatenate([h[i] for h in held]) for i in range(3)))

    def rows() -> pa.RecordBatch:
        high, low, f = compact()
        use = f >= least
        keys = packed(high[use], low[use], n)
        return pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(f[use], pa.int64())], names=["key", "f"])

    for b in batches:
        for part, keys, counts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if part != now:
                if held:
                    yield rows()
                now, held, size = part, [], 0
            held.append((*unpacked(keys, n), np.frombuffer(counts, "<u4").astype(np.int64)))
            size += len(held[-1][2])
            if size > 2 * KEYS:
                held = [compact()]
                size = len(held[0][2])
    if held:
        yield rows()


def bit_batches(batches: Iterator[pa.RecordBatch], n: int, bits: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        high, low = unpacked(b"".join(b.column(0).to_pylist()), n)
        at = (mixed_key(high, low) & np.uint64(bits - 1)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((at // SEGMENT).astype(np.int32)), pa.array(at % SEGMENT)], names=["segment", "at"])


def segment_frame(x: pd.DataFrame, size: int) -> pd.DataFrame:
    out = np.zeros(size, np.uint8)
    out[x["at"].to_numpy()] = 1
    return pd.DataFrame({"segment": [x["segment"].iloc[0]], "bits": [np.packbits(out, bitorder="little").tobytes()]})


def bitmap(spark: SparkSession, frequent: DataFrame, n: int) -> Broadcast:
    """The hashes of frequent phrases as bits, of which at most MOST_BITS travel."""
    bits, count = LEAST_BITS, frequent.count()
    while bits < MOST_BITS and bits < 16 * count:
        bits *= 2
    size = min(bits, SEGMENT)
    places = frequent.select("key").mapInArrow(lambda it: bit_batches(it, n, bits), "segment int, at long")
    out = np.zeros(bits // 8, np.uint8)
    for r in places.groupBy("segment").applyInPandas(lambda x: segment_frame(x, size), "segment int, bits binary").collect():
        out[r["segment"] * (size // 8) : (r["segment"] + 1) * (size // 8)] = np.frombuffer(r["bits"], np.uint8)
    return spark.sparkContext.broadcast(out)


def numbered(spark: SparkSession, frequent: DataFrame, count: int) -> DataFrame:
    """(number, lang, word, f): words numbered from 1, by slices of the hash and ranks in them."""
    slices = max(1, -(-count // 500_000))
    sliced = frequent.withColumn("slice", F.pmod(F.xxhash64("lang", "word"), F.lit(slices)).cast("int"))
    sizes = {r["slice"]: r["count"] for r in sliced.groupBy("slice").count().collect()}  # one row per 500,000 words
    before, start = [], 0
    for s in range(slices):
        before.append(start)
        start += sizes.get(s, 0)
    if start >= 1 << 32:
        raise ValueError("more than 2**32 frequent words")
    rank = F.row_number().over(Window.partitionBy("slice").orderBy("lang", "word"))
    offset = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("slice") + 1)
    return written(spark, sliced.select((rank + offset).cast("long").alias("number"), "lang", "word", "f"))


def encoded(spark: SparkSession, docs: DataFrame, dictionary: DataFrame, count: int) -> DataFrame:
    """The texts as runs of numbers, written."""
    if count <= DICTIONARY:
        hashes = dictionary.select("lang", "word", "number").mapInArrow(dictionary_batches, "one long, two long, number long").toPandas()
        one = hashes["one"].to_numpy().view(np.uint64)
        shared = spark.sparkContext.broadcast(Dictionary(one, hashes["two"].to_numpy().view(np.uint64), hashes["number"].to_numpy()))
        with arrow_rows(spark, TEXTS):
            return written(spark, docs.select("lang", "text").mapInArrow(lambda it: encoded_batches(it, shared), "ids binary"))
    return written(spark, joined_ids(docs, dictionary))


def phrase_counts(spark: SparkSession, texts: DataFrame, words: int, longest: int, least: int) -> list[DataFrame]:
    """(key, f) of the frequent phrases of 2 words, of 3 words, and so on."""
    out: list[DataFrame] = []
    shared = None
    for n in range(2, longest + 1):
        ranges = int(min(MOST_RANGES, max(1, -(-words // RANGE))))
        keys = texts.mapInArrow(lambda it, n=n, r=ranges, s=shared: key_batches(it, n, r, s), "part int, keys binary, counts binary")
        frequent = keys.repartition("part").sortWithinPartitions("part").mapInArrow(lambda it, n=n: merged_batches(it, n, least), "key binary, f long")
        with arrow_rows(spark, BLOCKS):
            out.append(written(spark, frequent))
        if n < longest:
            shared = bitmap(spark, out[-1], n)
    return out


def collocations(spark: SparkSession, docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, inside: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    ``docs`` has lang and text.  A phrase of 2 to ``longest`` words occurs ``least`` times; one inside a longer phrase that
    has ``inside`` percent of its occurrences is dropped.  The score is that of the cut with the lowest floor(2000000 * a / (l + r)).
    """
    counts = docs.select("lang", "text").mapInArrow(counted_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    with arrow_rows(spark, TEXTS):
        kept = written(spark, counts.filter((F.col("f") >= least) | F.col("word").isNull()))
    totals = kept.filter("word IS NULL").select(F.col("lang").alias("of"), F.col("f").alias("n"))
    frequent = kept.filter(F.col("word").isNotNull() & (F.col("f") >= least))
    count, words = frequent.count(), totals.agg(F.sum("n")).first()[0] or 0
    dictionary = numbered(spark, frequent, count)
    texts = encoded(spark, docs, dictionary, count)
    by_length = phrase_counts(spark, texts, words, longest, least)
    forget(spark, texts)
    one = dictionary.select(F.unhex(F.lpad(F.hex("number"), 8, "0")).alias("key"), "f")
    candidates = by_length[0]
    for df in by_length[1:]:
        candidates = candidates.unionByName(df)
    every = one.unionByName(candidates)
    size = (F.length("key") / 4).cast("int")
    # what lies inside of a longer candidate that has most of its occurrences
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(0), size - m), lambda i: F.substring("key", i * 4 + 1, m * 4))))
    longer = candidates.filter(size > 2).select(F.explode(spans).alias("key"), F.col("f").alias("longer")).groupBy("key").agg(F.max("longer").alias("longer"))
    share = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("f").cast("decimal(20,0)") * inside
    left = written(spark, candidates.join(longer, "key", "left").filter(~F.coalesce(share, F.lit(False))).select("key", F.col("f").alias("a")))
    # both parts of each cut
    part = lambda side, start, length: F.struct(F.lit(side).alias("side"), F.substring("key", start, length).alias("part"))
    cuts = left.select("key", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("key", "a", "k", F.explode(F.array(part("l", F.lit(1), F.col("k") * 4), part("r", F.col("k") * 4 + 1, F.length("key") - F.col("k") * 4))).alias("p"))
    known = checked(every.select(F.col("key").alias("part"), "f"))
    both = cuts.select("key", "a", "k", "p.side", "p.part").join(known, "part")
    sides = both.groupBy("key", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    score = F.expr("(CAST(a AS DECIMAL(20,0)) * 2000000) div (CAST(l AS DECIMAL(20,0)) + r)")
    lowest = sides.withColumn("score", score).groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("key", "a", "m.l", "m.r", "m.score")
    number = lambda i: F.conv(F.hex(F.substring("key", i * 4 + 1, 4)), 16, 10).cast("long")
    # languages are few, but the dictionary may be large: it meets only what can be among the first
    langs = checked(dictionary.select(F.col("number").alias("w"), "lang"))
    scored = lowest.withColumn("w", number(F.lit(0))).join(langs, "w").drop("w")
    near = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = written(spark, scored.withColumn("near", F.rank().over(near)).filter(F.col("near") <= top).drop("near"))
    spelled = first.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), size - 1), number)).alias("i", "w"))
    names = spelled.join(checked(dictionary.select(F.col("number").alias("w"), "word")), "w").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("x"))
    named = first.join(names.select("key", F.array_join(F.col("x.word"), " ").alias("phrase")), "key")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(checked(totals), F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


ship(__name__)
