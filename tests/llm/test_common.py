"""Helpers that the operators share, and branches that ordinary data never reach."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from relevara.llm import common, exact_dedup
from relevara.llm.graph import components
from relevara.llm.ngram_jaccard import jaccard_components


def test_components_against_union_find(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(0, i) for i in range(400, 480)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    out = {r.node: r.label for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {n: root(n) for n in parent}
    assert components(spark, spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


def test_drop_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, None), (2, "c")], "doc_id long, text string").withColumn("row", F.lit(5))
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    fate = lambda *rows: spark.createDataFrame(rows, "doc_id long, t string, n_kept int").select("doc_id", F.xxhash64("t").alias("text_hash"), "n_kept")
    left = common.drop_rows(spark, docs, fate((1, "a", 1), (None, "a", 0), (2, "x", 0)))
    assert sorted((r.doc_id or 0, r.text or "", r.row) for r in left.collect()) == [(0, "", 5), (1, "a", 5), (1, "b", 5), (2, "c", 5)]
    assert left.columns == docs.columns and docs.select(h).count() == 6
    assert common.drop_rows(spark, docs.limit(0), fate((1, "a", 0))).collect() == []


def test_sides_are_broadcast_within_rows_and_bytes(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    few, long = spark.range(10), spark.createDataFrame([("x" * 5000,)] * 10, "t string")
    assert hinted(common.checked(few)) and not hinted(common.checked(few, limit=9)) and not hinted(common.checked(few, most=40))
    assert hinted(common.checked(long)) and not hinted(common.checked(long, most=40_000))


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(Session())


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    """With bases of zero a fingerprint is the text's last byte and its length."""
    monkeypatch.setattr(sys.modules["relevara.llm.exact_dedup"], "BASES", (0, 0, 0, 0))
    rows = [(1, "abz"), (2, "cbz"), (3, "ab z"), (4, "cbz"), (5, "abzz"), (6, "q"), (7, None), (8, " ")]
    out = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (3, 2, False), 3: (3, 2, True), 2: (2, 2, True), 4: (2, 2, False), 5: (5, 1, True), 6: (6, 1, True), 7: (8, 2, False), 8: (8, 2, True)}


def test_jaccard_of_a_common_passage(spark):
    """Texts that share a long passage link only as their own parts allow, whatever the number of texts."""
    rnd = random.Random(2)
    word = lambda: f"w{rnd.randrange(10**7)}"
    passage = [word() for _ in range(60)]
    texts = [" ".join(passage + [word() for _ in range(rnd.choice([3, 8, 10, 14, 40]))]) for _ in range(60)]
    texts += [" ".join([*t.split()[:-1], "changed"]) for t in texts[:20]] + [" ".join(passage)] * 3
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in jaccard_components(spark, docs, 4, 85, 100).collect()}
    assert out == dict(enumerate(label)) and 1 < len(set(label)) < len(texts)
