"""JSON arrays of any size, one file or many, as one row for each element: a file feeds as many tasks as it has blocks.

A file is read as text parted at closing braces, which Spark cuts into blocks like any lines.  Whether a block begins
inside a string, and how deep, depends on all blocks before it, but a block does only two things to
that: it turns the string state or leaves it, and changes the depth by one number for each state that it may begin in.
These few numbers of each block come first; from them the state at the start of every block follows, and
a second pass over the blocks cuts elements at the brackets and commas of the outer array.  An element that reaches over
blocks is put together from its pieces.

A gzip file cannot be cut and is unpacked by one task; its elements are dealt to others before they are parsed.

Defined cases: blank files and empty arrays have no elements; white space around elements is dropped; brackets, commas and
braces inside strings, escaped quotes and backslashes don't count; what stands outside of the outer array is dropped; in a file that
doesn't begin with a bracket each object at the top is an element.  Elements that are no JSON are left to the parser.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevara.sources.sinks import written

#: Bytes of one numpy step.
STEP = 4 << 20
QUOTE, BACKSLASH, COMMA, OPEN, CLOSE = b'"'[0], b"\\"[0], b","[0], tuple(b"[{"), tuple(b"]}")
#: White space and the bytes of a byte order mark.
BLANK = np.zeros(256, bool)
BLANK[[*b" \t\n\r\x0b\x0c", 0xEF, 0xBB, 0xBF]] = True


def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an odd number of quotes stand before or at each byte, and what each byte outside of a string does to the depth."""
    back = data == BACKSLASH
    at = np.arange(len(data))
    last = np.maximum.accumulate(np.where(back, -1, at)) if len(data) else at
    run = np.zeros(len(data), np.int64)  # backslashes right before a byte
    if len(data):
        run[1:] = np.where(back[:-1], at[:-1] - last[:-1], 0)
    quote = (data == QUOTE) & (run % 2 == 0)
    step = np.isin(data, OPEN).astype(np.int8) - np.isin(data, CLOSE).astype(np.int8)
    return np.cumsum(quote) % 2 == 1, step


def summary(data: np.ndarray) -> tuple[bool, int, int]:
    """What a block does: turns the string state or not; the change of depth if it begins outside of, and inside of a string."""
    odd, step = marks(data)
    return (bool(odd[-1]) if len(odd) else False), int(step[~odd].sum()), int(step[odd].sum())


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray]]:
    """(file, start of the block, some of its bytes) of rows (file, start, value) in their order; each value gets back its brace."""
    for b in batches:
        files, starts, values = (b.column(i).to_pylist() for i in range(3))
        i = 0
        while i < len(files):
            j, size = i, 0
            while j < len(files) and files[j] == files[i] and starts[j] == starts[i] and size < STEP:
                size += len(values[j]) + 1
                j += 1
            text = "".join(v + "}" for v in values[i:j])
            yield files[i], starts[i], np.frombuffer(text.encode(), np.uint8)
            i = j


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block: (file, start, turns, outside, inside, first), the last one its first byte that isn't blank, or 0."""
    now: tuple[str, int] | None = None
    turns, depth, first = False, [0, 0], 0
    for file, start, data in blocks(batches):
        if (file, start) != now:
            if now is not None:
                yield summary_row(now, turns, depth, first)
            now, turns, depth, first = (file, start), False, [0, 0], 0
        if not first and (seen := data[~BLANK[data]]).size:
            first = int(seen[0])
        odd, out, inside = summary(data)
        # a block that began in state s is in state s ^ turns now
        depth = [depth[s] + (inside if s ^ turns else out) for s in (0, 1)]
        turns ^= odd
    if now is not None:
        yield summary_row(now, turns, depth, first)


def summary_row(now: tuple[str, int], turns: bool, depth: list[int], first: int) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*now, turns, *depth, first), kinds, strict=True)], names=["file", "start", "turns", "outside", "inside", "first"])


def cut(batches: Iterator[pa.RecordBatch], states: dict[tuple[str, int], tuple[bool, int, bool]]) -> Iterator[pa.RecordBatch]:
    """(file, start, nth, part, text): the pieces of a block between the places where elements begin or end.

    ``nth`` counts the pieces of a block from 0: piece 0 goes on from the block before, the last one
    goes on in the next block.  ``part`` tells whether a piece makes the whole it belongs to an element: in an array one that begins in the outer
    array and not in an element, among objects the one that ends an object.
    """
    now, nth, inside, depth, array = None, 0, False, 0, True
    rows: list[tuple] = []
    rest: list[bytes] = []
    begun, size = 0, 0

    def close(ended: bool, level: int) -> None:
        nonlocal nth, rest, size, begun
        text = b"".join(rest)
        rows.append((now[0], now[1], nth, begun == 1 if array else ended, text.decode("utf-8", "replace")))
        nth, rest, size, begun = nth + 1, [], size + len(text), level

    for file, start, data in blocks(batches):
        if (file, start) != now:
            if now is not None:
                close(False, 0)
            now, nth, rest = (file, start), 0, []
            inside, depth, array = states[now]
            begun = depth
        odd, step = marks(data)
        free = odd == inside  # outside of a string, given how the block began
        level = depth + np.cumsum(np.where(free, step, 0))
        if array:
            ends = ((data == COMMA) & (level == 1)) | ((data == OPEN[0]) & (level == 1)) | ((data == CLOSE[0]) & (level == 0))
        else:
            ends = (data == CLOSE[1]) & (level == 0)
        at, whole = 0, data.tobytes()
        for e in np.flatnonzero(ends & free).tolist():
            rest.append(whole[at : e if array else e + 1])
            at = e + 1
            close(True, int(level[e]))
            if size > STEP:
                yield piece_rows(rows)
                rows, size = [], 0
        rest.append(whole[at:])
        if len(data):
            depth, inside = int(level[-1]), bool(odd[-1]) ^ inside
    if now is not None:
        close(False, 0)
    yield piece_rows(rows)


def piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["file", "start", "nth", "part", "text"])


def elements(spark: SparkSession, paths: str | list[str], parts: int | None = None) -> DataFrame:
    """(file, element): the elements of the JSON arrays at ``paths`` as text; ``file`` is the path.

    ``parts`` deals whole elements to so many tasks, which a gzip file needs; without it they stay where they were cut.
    """
    lines = spark.read.option("lineSep", "}").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.coalesce("value", F.lit("")).alias("value"))
    found = lines.mapInArrow(summaries, "file string, start long, turns boolean, outside long, inside long, first long").collect()  # one row per block
    states: dict[tuple[str, int], tuple[bool, int, bool]] = {}
    owner: list[tuple[str, int, int, int]] = []
    now, inside, depth, first = None, False, 0, 0
    for r in sorted(found, key=lambda r: (r["file"], r["start"])):
        if r["file"] != now:
            now, inside, depth, first = r["file"], False, 0, 0
        first = first or r["first"]
        states[r["file"], r["start"]] = (inside, depth, first == OPEN[0])
        depth += r["inside"] if inside else r["outside"]
        inside ^= r["turns"]
    shared = spark.sparkContext.broadcast(states)
    pieces = written(spark, lines.mapInArrow(lambda it: cut(it, shared.value), "file string, start long, nth long, part boolean, text string"), "pieces")
    # the last piece of a block goes on in the first one of the next, and that of a block without a cut in the one after it
    last = pieces.groupBy("file", "start").agg(F.max("nth").alias("last")).collect()  # one row per block
    began: dict[str, tuple[int, int]] = {}
    for r in sorted(last, key=lambda r: (r["file"], r["start"])):
        first = began.get(r["file"], (r["start"], 0))
        owner.append((r["file"], r["start"], *first))
        began[r["file"]] = first if r["last"] == 0 else (r["start"], r["last"])
    ends = spark.createDataFrame([(r["file"], r["start"], r["last"]) for r in last], "f string, s long, last long")
    owners = spark.createDataFrame(owner, "f2 string, s2 long, own_start long, own_nth long")
    same = (F.col("file") == F.col("f")) & (F.col("start") == F.col("s"))
    marked = pieces.join(F.broadcast(ends), same)
    inner = marked.filter((F.col("nth") > 0) & (F.col("nth") < F.col("last")) & F.col("part")).select("file", "text")
    edge = marked.filter((F.col("nth") == 0) | (F.col("nth") == F.col("last"))).join(F.broadcast(owners), (F.col("file") == F.col("f2")) & (F.col("start") == F.col("s2")))
    key = lambda first, own: F.when(F.col("nth") == 0, F.col(own)).otherwise(F.col(first))
    joined = edge.groupBy("file", key("start", "own_start").alias("a"), key("nth", "own_nth").alias("b")).agg(F.max("part").alias("part"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "nth", "text"))), lambda x: x["text"]), "").alias("text"))
    every = inner.unionByName(joined.filter("part").select("file", "text"))
    out = every.select("file", F.regexp_replace("text", r"^\s+|\s+$", "").alias("element")).filter("element <> ''")
    return out.repartition(parts) if parts else out


# functions go to the executors by value, which need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
