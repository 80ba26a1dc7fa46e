"""Best-fit packing by minimum bin slack.

Texts become token ids with an end id; only those longer than a sequence are cut, the first
piece taking the remainder.  Which lengths share a sequence is decided on the histogram of
lengths alone, which has at most ``capacity`` rows whatever the corpus: per bin, the longest
length left is placed and a bitset subset-sum over all lengths left finds the fullest feasible
combination, which is then removed.  While the counts allow it the same combination would be
found again, so it is taken as many times at once.  Pieces then find their place by their rank
among the pieces of equal length; ranks are counted within tasks and shifted by the counts of
earlier tasks, so that a length that most pieces share needs no common group.

Defined cases: a null text counts as empty and is one piece that holds the end id alone; a null
doc_id keeps its row; repeated rows are packed as often as they occur; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevara.llm.common import checked, released, ship, text_session, written

#: Chunks whose ids a worker remembers, and their characters; beyond either the memory starts anew.
REMEMBERED, REMEMBERED_CHARS = 800_000, 1 << 24
_MEMORY: dict = {}


class Encoder:
    """Ids as little-endian bytes; equal chunks between single spaces are encoded once.

    The pre-tokenizer starts anew at a space between two other characters, so a text without
    white space on both sides of a space is the sequence of its chunks, each with its space.
    Other texts are encoded whole.
    """

    def __init__(self, vocabulary: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = special_as_text
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True  # the byte-level space
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes | None] = {}
        self.chars = 0

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, chunks: set[str]) -> None:
        """Remembers the ids of chunks after a space; None for those that white space starts."""
        new = list(chunks.difference(self.later))
        self.chars += sum(map(len, new))
        if len(self.later) + len(new) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.later.clear()
            new = list(chunks)
            self.chars = sum(map(len, new))
        plain = []
        for c in new:
            if c and not c[0].isspace():
                plain.append(c)
            else:
                self.later[c] = self.ids(" ").tobytes() if not c else None
        for i in range(0, len(plain), 256):  # many chunks in one call, told apart by their spaces
            part = plain[i : i + 256]
            ids = self.ids(" " + " ".join(part))
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(part):
                raw, ends = ids.tobytes(), [*(4 * at[1:]).tolist(), 4 * len(ids)]
                self.later.update(zip(part, [raw[a:b] for a, b in zip((4 * at).tolist(), ends, strict=True)], strict=True))
            else:
                self.later.update((c, self.ids(" " + c).tobytes()) for c in part)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if "  " in t else t.split(" ") for t in texts]
        known = [s for s in split if s is not None]
        self.learn(set().union(*(s[1:] for s in known)) if known else set())
        if len(self.first) > 1000:
            self.first.clear()
        later, out = self.later.__getitem__, []
        for t, s in zip(texts, split, strict=True):
            ids = None if s is None else [self.first.get(s[0]) or self.first.setdefault(s[0], self.ids(s[0]).tobytes()), *map(later, s[1:])]
            out.append(self.ids(t).tobytes() if ids is None or None in ids else b"".join(ids))
        return out


def encoder(vocabulary: str, special_as_text: bool) -> Encoder:
    """One encoder for each vocabulary in a worker, kept between tasks."""
    key = (len(vocabulary), zlib.crc32(vocabulary.encode()), special_as_text)
    if key not in _MEMORY:
        _MEMORY[key] = Encoder(vocabulary, special_as_text)
    return _MEMORY[key]


def piece_batches(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, capacity: int, with_ids: bool, special_as_text: bool) -> Iterator[pa.RecordBatch]:
    """Rows of PIECES: for each piece its place in the document and its rank among equal lengths in this task."""
    enc, part, seen = encoder(vocabulary, special_as_text), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        at, size = 0, 0
        while at < len(texts):  # about 4 MB of text at a time
            size, to = 0, at
            while to < len(texts) and (to == at or size < 1 << 22):
                size, to = size + len(texts[to]), to + 1
            cols: list[list] = [[] for _ in range(8)]
            for doc_id, ids in zip(batch.column(0).slice(at, to - at).to_pylist(), enc.encode(texts[at:to]), strict=True):
                ids += end
                cut = len(ids) % width or width
                bounds = [0, *range(cut, len(ids), width), len(ids)]
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    n = (b - a) // 4
                    row = (doc_id, k, a // 4, n, zlib.crc32(ids[a:b]), part, int(seen[n]), np.frombuffer(ids[a:b], "<i4") if with_ids else None)
                    seen[n] += 1
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
            at = to


def fullest(counts: dict[int, int], capacity: int) -> list[int]:
    """The lengths of the fullest bin that holds the longest length left, longer ones preferred."""
    lengths = sorted(counts, reverse=True)
    seed = lengths[0]
    room, reach, steps = capacity - seed, 1, []
    mask = (1 << (room + 1)) - 1
    for length in lengths:
        if length > room:
            continue
        left, k = min(counts[length] - (length == seed), room // length), 1
        while left > 0:  # bounded multiplicities, in powers of two
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << (length * k) & mask
            left, k = left - k, k * 2
    at, out = reach.bit_length() - 1, [seed]
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= length * k
            out += [length] * k
    return out


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins), in the order they are made."""
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        bin_ = fullest(left, capacity)
        uses = {k: bin_.count(k) for k in set(bin_)}
        times = min(left[k] // n for k, n in uses.items())
        out.append((bin_, times))
        for k, n in uses.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def slots(bins: list[tuple[list[int], int]], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (length * 2**40 + first rank, first bin, uses per bin, offset in the bin), sorted; and bins in all."""
    rows, taken, base = [], {}, 0
    for lengths, times in bins:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            n = lengths.count(length)
            first = taken.get(length, 0)
            rows.append((length << 40 | first, base, n, offset))
            taken[length] = first + n * times
            offset += n * length
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1:], np.array([base], np.int64)


def place_frames(frames: Iterator[pd.DataFrame], keys: np.ndarray, table: np.ndarray) -> Iterator[pd.DataFrame]:
    for x in frames:
        length, rank = x["length"].to_numpy(np.int64), x["rank"].to_numpy(np.int64) + x["before"].to_numpy(np.int64)
        if not len(length):
            continue
        at = np.searchsorted(keys, length << 40 | rank, "right") - 1
        base, uses, offset = table[at].T
        j = rank - (keys[at] & (1 << 40) - 1)
        yield x.drop(columns=["rank", "before", "part"]).assign(sequence_id=base + j // uses, offset=offset + j % uses * length)


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset [, ids].

    ``vocabulary`` is the path of a tokenizer's JSON file, read on the driver.  A special token's string in
    a text becomes its id, as the tokenizer does by itself, or ordinary tokens with ``special_as_text``.
    """
    text_session(spark)
    source = Path(vocabulary).read_text(encoding="utf-8")
    json.loads(source)
    shared = spark.sparkContext.broadcast(source)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long, ids array<int>"
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = written(spark, flat.mapInArrow(lambda it: released(piece_batches(it, shared.value, end_id, capacity, with_ids, special_as_text)), schema))
    if not with_ids:
        pieces = pieces.drop("ids")
    # how many pieces of each length come from each task: at most ``capacity`` rows a task
    counts = written(spark, pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    keys, table, _ = slots(minimum_bin_slack(histogram, capacity), capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = written(spark, counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    ranked = pieces.join(checked(shift), ["part", "length"])
    plan = spark.sparkContext.broadcast((keys, table))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    cols = [c.split()[0] for c in out.split(", ")]
    placed = ranked.select(*cols, "part", "rank", "before").mapInPandas(lambda it: place_frames(it, *plan.value), out + ", sequence_id long, offset long")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


ship(__name__)
