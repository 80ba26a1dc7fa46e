"""Vectorised views of whole text batches: numpy over Arrow buffers, never a Python loop over characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from relevara.llm.common import ship

#: White space as the contracts define it: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


BYTE64 = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
SHINGLE = mix(np.arange(101, 165, dtype=np.uint64) * _ODD) | np.uint64(1)


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(0xD6E8FEB86659FD93), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(1024)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the offsets of each; null counts as empty."""
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        col = col.cast(pa.large_string() if pa.types.is_string(col.type) else pa.large_binary())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_large_string(col.type) else b"")
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if off else np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(batch: pa.RecordBatch, text: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes of text; a longer text is a run of its own."""
    col, start, size = batch.column(text), 0, 0
    lens = np.diff(buffers(col)[1]) if batch.num_rows else []
    for i, n in enumerate(lens):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased), words before each text, words' first bytes, and last two bytes."""
    global _POWERS
    low = LOWER[data]
    keep = ~SPACE[low]
    start = keep.copy()
    start[1:] &= ~keep[:-1]
    first = off[:-1][off[:-1] < len(low)]
    start[first] = keep[first]
    kept = np.flatnonzero(keep)
    low = low[kept]
    at = np.flatnonzero(start[kept])
    if not len(at):
        zero = np.zeros(0, np.uint64)
        return zero, np.zeros(len(off), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(low)))
    if size.max() > len(_POWERS):
        _POWERS = powers(int(size.max()) * 2)
    place = np.arange(len(low)) - np.repeat(at, size)
    sums = np.add.reduceat(BYTE64[low] * _POWERS[place], at)
    end = at + size - 1
    tail = low[end].astype(np.int64) * 256 + np.where(size > 1, low[np.maximum(end - 1, 0)], 0)
    return mix(sums + size.astype(np.uint64) * _ODD), np.searchsorted(kept[at], off), kept[at], tail


def shingle_hashes(words: np.ndarray, cut: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles, and shingles before each text; a shorter text is one shingle as a whole."""
    count = np.diff(cut)
    many = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    ends = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(int(ends[-1]), np.uint64)
    full = count >= n
    if full.any():
        own = np.repeat(np.arange(len(count)), np.where(full, many, 0))
        first = np.cumsum(np.where(full, many, 0)) - np.where(full, many, 0)
        rank = np.arange(len(own)) - first[own]
        at = cut[:-1][own] + rank
        total = np.zeros(len(at), np.uint64)
        for i in range(n):
            total += words[at + i] * SHINGLE[i]
        out[ends[:-1][own] + rank] = mix(total)
    for d in np.flatnonzero((count > 0) & ~full):
        w = words[cut[d] : cut[d + 1]]
        out[ends[d]] = mix(np.array([(w * SHINGLE[n : n + len(w)]).sum() + np.uint64(len(w))], np.uint64))[0]
    return out, ends


def distinct_sets(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, ascending (the global order), and their offsets."""
    parts, n = [], [0]
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        s = np.sort(hashes[a:b])
        if len(s) > 1:
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        parts.append(s)
        n.append(n[-1] + len(s))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array(n, np.int64)


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of each run of values, 0 for an empty one."""
    out = np.zeros(len(off) - 1, values.dtype)
    full = off[:-1] < off[1:]
    if full.any():
        out[full] = np.add.reduceat(values, off[:-1][full])
    return out


ship(__name__)
