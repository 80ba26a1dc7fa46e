"""Results that must not depend on neighbours, batches, partitions or the ratio of sample and table."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from relevara.llm import language_id, quality
from relevara.llm.language_id import Parser, automaton_frame, identify, symbols
from relevara.llm.mixing import mix
from relevara.llm.textvec import buffers

DATA = "/root/testdata/sf0.001"


def test_symbols_of_a_text_are_its_own():
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("ab Ü(1é\n") for _ in range(rnd.randrange(0, 9))) for _ in range(800)] + ["", " a", "é", "(", "1x"]
    s, off = symbols(*buffers(pa.array(texts)))
    for t, a, b in zip(texts, off[:-1], off[1:], strict=True):
        alone, _ = symbols(*buffers(pa.array([t])))
        assert s[a:b].tobytes() == alone.tobytes(), t


def folded(text):
    """Symbols by a loop over the bytes."""
    out, prev = [], 0
    for c in text.encode():
        x = c + 32 if 65 <= c < 91 else c if 97 <= c < 123 or c > 127 else 0
        if prev == 0xC3 and 0x80 <= c < 0x9F:
            x = c + 32
        if x or (out and out[-1]):
            out.append(x)
        prev = c
    return bytes(out)


def plain_identify(rows, use):
    """lang_pred and score of each row by samples, greedy parses and sums, all by loops."""
    order = lambda d: int(np.int64(np.uint64(xxhash.xxh64(("" if d is None else str(d)).encode(), seed=42).intdigest())))
    train = {}
    for d, lang, text in sorted({(d, lang, t) for d, lang, t in rows if use(d) and lang is not None and t is not None}, key=lambda r: (order(r[0]), r[2])):
        have = train.setdefault(lang, b"")
        if len(have) + len(folded(text)) < language_id.SYMBOLS:
            train[lang] = have + folded(text) + b"\0"
    langs, out = sorted(train), []
    for _, _, text in rows:
        if text is None or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        s, bits = folded(text), []
        for lang in langs:
            i = n = 0
            while i < len(s):
                size = 1
                while i + size < len(s) and s[i : i + size + 1] in train[lang]:
                    size += 1
                i, n = i + size, n + 1
            bits.append(n * np.log2(max(len(train[lang]), 2)))
        best = int(np.argmin(bits))
        out.append((langs[best], float(1 / np.exp(-(np.array(bits) - bits[best]) / language_id.SOFTNESS).sum())))
    return out


def test_language_id_against_a_plain_version(spark):
    """The whole result over a sample of documents with awkward rows, under two partitionings and batch sizes."""
    rows = [(r.doc_id, r.lang, r.text[:1500]) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows += [(900, "de", " (haus hund qqw"), (901, None, "haus hund qqw"), (902, "en", None), (903, "en", ""), (904, "en", "12 !"), (None, "en", "the cat"), (None, None, None), (905, "en", "the " * 700), rows[3]]
    use = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 4 != 2
    want = sorted((d is not None, d or 0, lang, round(score, 9)) for (d, _, _), (lang, score) in zip(rows, plain_identify(rows, use), strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for parts in (1, 7):
        out = identify(spark, docs.repartition(parts), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 != 2)
        if parts == 7:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        got = sorted((r.doc_id is not None, r.doc_id or 0, r.lang_pred, round(r.score, 9)) for r in out.collect())
        assert got == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_many_labels_share_the_bound(spark, monkeypatch):
    monkeypatch.setattr(language_id, "ALL_SYMBOLS", 400)
    docs = spark.createDataFrame([(i, f"l{i % 20:02}", f"{chr(97 + i % 20)}word " * 30) for i in range(60)], "doc_id long, lang string, text string")
    models = language_id.train(spark, docs, F.lit(True))
    assert len(models) == 20 and all(m[1] <= 20 for m in models)
    assert len(Parser(models).langs) == 20


def test_long_texts_are_sampled_only_where_there_are_no_others(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(language_id, "LONGEST", 40)
    docs = spark.createDataFrame([(1, "a", "x" * 50), (2, "a", "yy"), (3, "b", "z" * 60), (4, "b", "z" * 55)], "doc_id long, lang string, text string")
    got = sorted((r.lang, r.text) for r in language_id.sample(spark, docs, F.lit(True), 10).collect())
    assert got == [("a", "yy"), ("b", "z" * 55)]
    assert automaton_frame(pd.DataFrame({"lang": "b", "order": [1], "text": ["z" * 55]}), 10).iloc[0].n_symbols == 10


@pytest.mark.parametrize("parts", ["3", "200"])
def test_mixing_under_any_number_of_shuffle_partitions(spark, parts):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "w " * (i % 4)) for i in range(900)], "doc_id long, source string, text string")
    base = sorted(map(tuple, mix(spark, docs).select("doc_id", "copies").collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert sorted(map(tuple, mix(spark, docs).select("doc_id", "copies").collect())) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_quality_sample_is_exact_at_any_ratio(spark, monkeypatch):
    """A share below 1 / 10000: the scorer is trained on exactly so many rows."""
    text = "This is a plain sentence of ten words, more or less. "
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(text * 3), F.col("id").cast("string")).alias("text"))
    docs = docs.union(docs.limit(50))  # repeated rows count once
    seen = []
    keep = quality.written
    monkeypatch.setattr(quality, "written", lambda s, df: seen.append(df) or keep(s, df))
    monkeypatch.setattr(quality, "PASSES", 1)
    for n in (2, 7):
        seen.clear()
        assert quality.quality_scores(spark, docs, fit_rows=n).count() == 30_050
        assert [d.count() for d in seen if d.columns == ["label", "text"]] == [n]


def test_quality_without_a_sample(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
    assert quality.quality_scores(spark, docs, fit_rows=0).count() == 2


def test_top_k_over_many_ranges(spark, monkeypatch):
    """Ranges and blocks of few rows, sums in levels of two, columns whose names clash; against all products."""
    from relevara.llm import inner_product

    for name, value in {"BLOCK": 16, "QUERIES": 8, "FAN": 2}.items():
        monkeypatch.setattr(inner_product, name, value)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 6)) * rng.pareto(1.5, (700, 1))  # lengths differ much, so ranges are left out
    rows = [(i, [float(c) for c in v], 1, "x", 2.0) for i, v in enumerate(x)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, data string, norm double")
    got = {}
    for r in inner_product.norm_sorted_search(spark, docs, F.col("vec_id") % 10 == 0, 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    whole = np.floor(x * 1024).astype(np.int64)
    for q in range(0, 700, 10):
        s = whole @ whole[q]
        best = sorted((int(-s[i]), i) for i in range(700) if i != q)[:5]
        assert got[q] == {n + 1: (i, -s) for n, (s, i) in enumerate(best)}


def test_mixing_rates_are_those_of_a_bisection(spark):
    """Copies along the sizes of a source follow the tilted rates, found here by bisection of the dual, up to rounding and what closes the gap."""
    rnd = random.Random(5)
    sizes = {s: [rnd.choice([1, 2, 3, 5, 8, 13, 40, 90]) for _ in range(n)] for s, n in (("a", 260), ("b", 500), ("c", 900))}
    rows = [(f"{s}{i}", s, n) for s, ns in sizes.items() for i, n in enumerate(ns)]
    docs = spark.createDataFrame([(i, s, "w " * n) for i, (_, s, n) in enumerate(rows)], "doc_id long, source string, text string")
    out = mix(spark, docs).toPandas()
    for s, g in out.groupby("source"):
        target, n, mean = g["target"].iloc[0], np.array(sizes[s], float), np.mean(sizes[s])
        lo, hi = -50.0, 50.0
        for _ in range(200):
            tilt = (lo + hi) / 2
            rate = 3 / (1 + 2 * np.exp(-np.clip(tilt * n / mean, -700, 700)))
            lo, hi = (tilt, hi) if (n * rate).sum() < target else (lo, tilt)
        assert abs((n * rate).sum() - min(target, 3 * n.sum())) < 1e-3 * target
        assert abs(g["taken"].sum() - target) <= max(1, 0.001 * target)
        upto = 0.0
        for size in sorted(set(sizes[s])):
            own = g[g["size"] == size]["copies"]
            upto += size * len(own) * 3 / (1 + 2 * np.exp(-tilt * size / mean))
            assert own.max() - own.min() <= 1  # documents of one size share evenly
            # rounding along the sizes leaves less than a copy, and closing the gap moves as many words as that
            assert abs(g[g["size"] <= size]["taken"].sum() - upto) <= 2 * max(sizes[s])
