"""Collocations against plain counting: awkward texts, long ones, a dictionary that may not travel, ranges and blocks."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from relevara.llm import collocations as col
from relevara.llm import queries

SCHEMA = "doc_id long, lang string, text string, word string, n int, f string"


def plain(rows, least, top=2000):
    """All phrases by dictionaries of tuples."""
    total, f = Counter(), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            if words:
                total[lang or "und"] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    f[lang or "und", tuple(words[i : i + n])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or any(q[0] == lang and len(q[1]) > len(p) and 100 * b >= 80 * a and any(q[1][i : i + len(p)] == p for i in range(len(q[1]))) for q, b in f.items()):
            continue
        score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -score) for lang, x in out.items() for i, (score, a, p, left, right) in enumerate(sorted(x)[:top]))


def texts():
    rnd, out = random.Random(5), []
    words = ["New", "york", "city", "the", "of", "a", "über", "ñ", "x" * 40, "\x01q", "to", "be", "or", "not"]
    for i in range(160):
        lang = ["en", "de", None, "en"][i % 4]
        parts = [rnd.choice(["New York City", "to be or not", "the", rnd.choice(words), f"rare{rnd.randrange(9999)}", rnd.choice("é\U0001f600z") * 2]) + rnd.choice([" ", " ", " ", "\t ", ", ", "\n", ". "]) for _ in range(rnd.choice([0, 1, 5, 40, 90]))]
        out.append((lang, "".join(parts)))
    passage = "one passage that every second document shares with others and more words of it"
    out += [("en", f"{passage} {i}. {passage}") for i in range(35)]
    out += [(None, None), ("en", ""), ("en", " \t.,"), ("xx", "alone")] + [out[1]] * 5
    return out


@pytest.mark.parametrize("small", [False, True])
def test_collocations_against_plain_counts(spark, monkeypatch, small):
    rows = texts()
    if small:  # texts cut in parts, tables and blocks passed on early, many ranges, bitmaps that let most pass
        for name, value in {"CHUNK": 64, "WORDS": 20, "KEYS": 50, "RANGE": 100, "LEAST_BITS": 64, "MOST_BITS": 128, "SEGMENT": 64}.items():
            monkeypatch.setattr(col, name, value)
    docs = spark.createDataFrame([(i, lang, t, "x", 1, "y") for i, (lang, t) in enumerate(rows)], SCHEMA)
    for least in (30, 3) if not small else (3,):
        got = sorted(map(tuple, col.collocations(spark, docs.repartition(5), least=least).collect()))
        assert got == plain(rows, least)
    if not small:
        got = sorted(map(tuple, col.collocations(spark, docs, least=3, top=7).collect()))
        assert got == plain(rows, 3, 7)
        assert col.collocations(spark, docs.limit(0)).collect() == []


def test_a_dictionary_that_may_not_travel(spark, monkeypatch):
    monkeypatch.setattr(col, "DICTIONARY", 3)
    rows = texts()
    docs = spark.createDataFrame([(i, lang, t, "x", 1, "y") for i, (lang, t) in enumerate(rows)], SCHEMA)
    assert sorted(map(tuple, col.collocations(spark, docs, least=5).collect())) == plain(rows, 5)


def test_long_text(spark, monkeypatch):
    """A text of 2 MB, cut after words, with one word longer than a part."""
    monkeypatch.setattr(col, "CHUNK", 1 << 16)
    rnd = random.Random(6)
    text = " ".join(rnd.choice(["aa", "bb cc dd", "ee.", f"r{rnd.randrange(10**6)}"]) for _ in range(300_000)) + " " + "w" * 200_000 + " bb cc"
    rows = [("en", text), ("en", "bb cc"), ("de", text[:1000])]
    docs = spark.createDataFrame([(i, lang, t, "x", 1, "y") for i, (lang, t) in enumerate(rows)], SCHEMA)
    assert sorted(map(tuple, col.collocations(spark, docs.coalesce(1)).collect())) == plain(rows, 30)


def test_runs_radix_order_and_keys():
    rng = np.random.default_rng(1)
    high, low = rng.integers(0, 1 << 63, 5000).astype(np.uint64) << np.uint64(1), rng.integers(0, 9, 5000).astype(np.uint64)
    high[::3] = high[0]
    assert (col.radix_order([high, low]) == np.lexsort((low, high))).all()
    for n in (2, 3, 4):
        ids = rng.integers(0, 4, 4000).astype(np.uint32)
        ids[ids > 0] += np.uint32(70_000)
        _, a, b = col.phrase_keys(ids, n)
        h, lo, f = col.run_lengths(a, b, None)
        want = Counter(tuple(ids[i : i + n].tolist()) for i in range(len(ids) - n + 1) if (ids[i : i + n] != 0).all())
        keys = col.packed(h, lo, n)
        assert {tuple(k.tolist()): c for k, c in zip(keys, f.tolist(), strict=True)} == want
        assert all((x == y).all() for x, y in zip(col.unpacked(keys.tobytes(), n), (h, lo), strict=True))
    d = col.Dictionary(high[1:3], low[1:3], np.array([7, 9]))
    assert d.numbers(high[:4], low[:4]).tolist()[1:3] == [7, 9] and d.numbers(high[1:3], low[1:3] + np.uint64(1)).tolist() == [0, 0]
    assert col.Dictionary(high[:0], low[:0], np.zeros(0, int)).numbers(high[:3], low[:3]).tolist() == [0, 0, 0]
    w = col.Words(*col.buffers(pa.array(["a b", "", "b. a", None])))
    assert w.new.tolist() == [True, False, True, True] and w.text.tolist() == [0, 0, 2, 2]


def test_query_matches_its_sql(spark):
    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{at}/documents.parquet')")
    want = con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({queries.ORACLE_SQL['op12_collocations']})").fetchall()
    assert len(want) > 100 and sorted(map(tuple, queries.op12_collocations(spark, at).collect())) == sorted(want)
