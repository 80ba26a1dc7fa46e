"""Exact dedup by composable polynomial fingerprints.

A text without white space is hashed in chunks; chunk hashes combine by length-shifted
arithmetic, H(xy) = H(x) * B**len(y) + H(y), so the chunks of a huge text are hashed in
parallel tasks and put together afterwards.  Texts with equal fingerprints are then compared
chunk by chunk: distinct chunks per place are counted after a map-side distinct, so that a
group of copies of any size sends one row per task.  Should fingerprints ever collide, the
SHA-256 of the text tells the members apart.

Defined cases: a null text counts as empty, and all empty texts are one group; a null doc_id
loses every tie; a row that is repeated whole stays once; extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevara.llm.common import checked, drop_rows, forget, released, ship, text_session, written
from relevara.llm.textvec import SPACE, buffers, pieces

PRIME = 2**31 - 1
BASES = (1_103_515_245, 1_664_525_013, 214_013_531, 1_597_334_677)
CHUNK = 1 << 16
#: Texts of more bytes are dealt out in chunks and hashed by many tasks.
HUGE = 1 << 22
KEYS = ["f1", "f2", "norm_len"]

PROFILE = "uid long, doc_id long, text_hash long, n_code_points long, text_sha256 string, norm_len long, f1 long, f2 long, chunk_no long, chunk binary"


def power_table() -> list[np.ndarray]:
    out = []
    for base in BASES:
        p = [1]
        for _ in range(CHUNK - 1):
            p.append(p[-1] * base % PRIME)
        out.append(np.array(p[::-1], np.uint64))
    return out


def chunk_hash(chunk: np.ndarray, table: list[np.ndarray]) -> list[int]:
    """One residue for each base; at most CHUNK bytes, so that the sums fit in 64 bits."""
    wide = chunk.astype(np.uint64) + np.uint64(1)
    return [int((wide * p[CHUNK - len(wide) :]).sum()) % PRIME for p in table]


def shifted(head: list[int], tail: list[int], tail_len: int) -> list[int]:
    """The fingerprint of head + tail from those of both and the tail's length."""
    return [(h * pow(b, tail_len, PRIME) + t) % PRIME for h, t, b in zip(head, tail, BASES, strict=True)]


def fingerprint(text: np.ndarray, table: list[np.ndarray]) -> list[int]:
    out = [0] * len(BASES)
    for i in range(0, len(text), CHUNK):
        part = text[i : i + CHUNK]
        out = shifted(out, chunk_hash(part, table), len(part))
    return out


def packed(h: list[int]) -> tuple[int, int]:
    return h[0] << 31 | h[1], h[2] << 31 | h[3]


def stripped(batch: pa.RecordBatch, text: int) -> tuple[np.ndarray, np.ndarray]:
    """The batch's texts without white space, as bytes in a row, and their offsets."""
    data, off = buffers(batch.column(text))
    keep = ~SPACE[data]
    before = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], before[off]


def profile_batches(batches: Iterator[pa.RecordBatch], huge: int = HUGE) -> Iterator[pa.RecordBatch]:
    """Per document: its fingerprint; of a huge one its chunks, to be hashed elsewhere."""
    table, uid = power_table(), TaskContext.get().partitionId() << 40
    for whole in batches:
        for batch in pieces(whole, 3):
            norm, off = stripped(batch, 3)
            raw = norm.tobytes()
            cols: list[list] = [[] for _ in range(10)]
            for i, (doc_id, text_hash, points) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                a, b = int(off[i]), int(off[i + 1])
                sha, uid = hashlib.sha256(raw[a:b]).hexdigest(), uid + 1
                if b - a <= huge:
                    rows = [(*packed(fingerprint(norm[a:b], table)), None, None)]
                else:
                    rows = [(None, None, k, raw[x : min(x + CHUNK, b)]) for k, x in enumerate(range(a, b, CHUNK))]
                for row in rows:
                    for col, v in zip(cols, (uid, doc_id, text_hash, points, sha, b - a, *row), strict=True):
                        col.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PROFILE.split(", ")])


def chunk_fingerprints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    table = power_table()
    for x in frames:
        h = [chunk_hash(np.frombuffer(c, np.uint8), table) for c in x["chunk"]]
        yield x.drop(columns="chunk").assign(size=[len(c) for c in x["chunk"]], h0=[y[0] for y in h], h1=[y[1] for y in h], h2=[y[2] for y in h], h3=[y[3] for y in h])


def combined(x: pd.DataFrame) -> pd.DataFrame:
    """A huge text's fingerprint from its chunks' (a few numbers for each 64 KiB)."""
    out = [0] * len(BASES)
    for r in x.sort_values("chunk_no").itertuples():
        out = shifted(out, [r.h0, r.h1, r.h2, r.h3], r.size)
    f1, f2 = packed(out)
    return x.head(1)[["uid", "doc_id", "text_hash", "n_code_points", "text_sha256", "norm_len"]].assign(f1=f1, f2=f2)


def place_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fingerprint, chunk number, chunk) of every text, for the comparison."""
    table = power_table()
    for whole in batches:
        for batch in pieces(whole, 0):
            norm, off = stripped(batch, 0)
            rows = []
            for a, b in zip(off[:-1], off[1:], strict=True):
                key = (*packed(fingerprint(norm[a:b], table)), int(b - a))
                rows += [(*key, k, norm[x : min(x + CHUNK, b)].tobytes()) for k, x in enumerate(range(a, b, CHUNK))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.binary()], strict=True)], names=[*KEYS, "chunk_no", "chunk"])


def profiles(spark: SparkSession, docs: DataFrame, huge: int = HUGE) -> DataFrame:
    """A written table with one fingerprinted row for each document."""
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_code_points"), "text")
    rows = written(spark, flat.mapInArrow(lambda it: released(profile_batches(it, huge)), PROFILE))
    one = ["uid", "doc_id", "text_hash", "n_code_points", "text_sha256", *KEYS]
    small = rows.filter("chunk_no IS NULL").select(one)
    if not rows.filter("chunk_no IS NOT NULL").select("uid").limit(1).count():
        return small
    parts = rows.filter("chunk_no IS NOT NULL").drop("f1", "f2").repartition("uid", "chunk_no")
    hashed = parts.mapInPandas(chunk_fingerprints, "uid long, doc_id long, text_hash long, n_code_points long, text_sha256 string, norm_len long, chunk_no long, size long, h0 long, h1 long, h2 long, h3 long")
    return written(spark, small.unionByName(hashed.groupBy("uid").applyInPandas(combined, "uid long, doc_id long, text_hash long, n_code_points long, text_sha256 string, norm_len long, f1 long, f2 long")))


def collisions(spark: SparkSession, docs: DataFrame, copies: DataFrame) -> DataFrame:
    """Fingerprints whose texts differ at some chunk, of the documents named by ``copies`` (doc_id)."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = checked(copies.select(F.col("doc_id").alias("copy_id")).distinct())
    texts = named.join(ids, named["doc_id"].eqNullSafe(ids["copy_id"]), "left_semi").select("text")
    places = texts.mapInArrow(lambda it: released(place_batches(it)), "f1 long, f2 long, norm_len long, chunk_no long, chunk binary").distinct()
    return places.groupBy(*KEYS, "chunk_no").count().filter("count > 1").select(KEYS).distinct()


def exact_dedup(spark: SparkSession, docs: DataFrame, huge: int = HUGE) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, uid, text_hash.

    Of equal texts the one with most code points stays, then the smallest doc_id.
    """
    text_session(spark)
    rows = profiles(spark, docs, huge)
    keys = KEYS
    best = F.struct("n_code_points", F.col("doc_id").isNotNull(), F.bitwise_not("doc_id"), F.bitwise_not("uid"))

    def groups(rows: DataFrame, keys: list[str]) -> DataFrame:
        found = rows.groupBy(*keys).agg(F.count("*").alias("group_size"), F.max_by(F.struct("doc_id", "uid"), best).alias("keep"))
        return written(spark, found.filter("group_size > 1"))

    copies = groups(rows, keys)
    n = copies.count()
    if n:
        members = rows.join(checked(copies.select(keys), n), keys, "left_semi")
        bad = written(spark, collisions(spark, docs, members))
        if n_bad := bad.count():
            rows = rows.join(checked(bad.withColumn("bad", F.lit(True)), n_bad), keys, "left").withColumn("apart", F.when(F.col("bad"), F.col("text_sha256")).otherwise(F.lit("")))
            forget(spark, copies)
            keys = [*KEYS, "apart"]
            copies = groups(rows, keys)
            n = copies.count()
        else:
            forget(spark, bad)
    out = rows.join(checked(copies, n), keys, "left")
    keep = F.col("keep")
    return out.select(
        "doc_id",
        F.when(keep.isNull(), F.col("doc_id")).otherwise(keep["doc_id"]).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (keep.isNull() | (keep["uid"] == F.col("uid"))).alias("kept"),
        "text_sha256",
        "uid",
        "text_hash",
    )


def without_copies(spark: SparkSession, docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops."""
    fate = decided.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept"))
    return drop_rows(spark, docs, fate.filter("n_kept < n"))


ship(__name__)
