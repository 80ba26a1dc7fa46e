"""The prefix trie against a plain version, and against its SQL on the small tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from relevara.llm import prefix_trie as trie
from relevara.llm import queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, conv long, key string, words int"


def plain_trie(rows, base, taken):
    """Nodes by prefixes as tuples; turns of one number in order of the hash of role and text."""
    own = defaultdict(list)
    name = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, name(role or "", text or ""), role or "", text or ""))
    seqs = {c: [x[3:] for x in sorted(own.get(base(c), []))[: taken(c)]] + [x[3:] for x in sorted(own[c])[taken(c) :]] for c in own}
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    children, out = defaultdict(list), []
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + ((len(members[p]) - 1) * words(p[-1][1]) if p else 0)
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if len(seqs[c]) == len(p)))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=lambda r: r[:2])


@pytest.fixture(scope="module")
def rows():
    rnd, out = random.Random(3), []
    say = lambda: rnd.choice(["hi", "hi there", "", None, "what is it ?", "a b\tc\nd", "né " * 4])
    for c in range(0, 140):
        if c in (20, 45):
            continue  # a base and another one are absent
        for t in range(rnd.choice([1, 1, 2, 3, 5])):
            out.append((c, t, rnd.choice(["user", "user", None]), say()))
    copy = [(t, "user", f"line {t} of a long one " * 3) for t in range(40)]
    out += [(c, *x) for c in (200, 204, 207, 213, 219, 300, 301) for x in copy]  # long equal conversations
    out += [(c, *x) for c in (220, 221) for x in copy[:6]] + [(221, 99, "user", "another end")]
    out += [(400, None, "system", "first"), (400, 3, "user", "tie"), (400, 3, "user", "a tie"), (400, 3, "user", "tie"), (None, 1, "user", "lost"), (401, None, None, None)]
    out += [(500, t, "user", "w " * (t % 7)) for t in range(300)]  # one conversation with most turns
    return out


def test_trie_against_a_plain_version(spark, rows, monkeypatch):
    docs = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SCHEMA)
    base, taken = (lambda c: c - c % 20), (lambda c: zlib.crc32(str(c).encode()) % 4)
    conv = F.col("conv")
    crc = F.crc32(conv.cast("string").cast("binary")) % 4
    want = plain_trie(rows, base, taken)
    assert found(trie.prefix_trie(spark, docs, conv - conv % 20, crc)) == want
    monkeypatch.setattr(trie, "RANGE", 100)  # many ranges, conversations and classes across their borders
    assert found(trie.prefix_trie(spark, docs.repartition(5), conv - conv % 20, crc)) == want
    assert found(trie.prefix_trie(spark, docs)) == plain_trie(rows, lambda c: c, lambda c: 0)


def test_trie_of_little(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(spark, none).collect() == []
    assert trie.prefix_trie(spark, spark.createDataFrame([(None, 1, "a", "b", 1, "x", 1)], SCHEMA)).collect() == []
    one = spark.createDataFrame([(21, 1, "a", "b c", 1, "x", 1)], SCHEMA)
    assert found(trie.prefix_trie(spark, one, F.col("conv") * 0, F.lit(3)))[0][:7] == (21, 0, None, 1, 0, 1, 0)


def test_trie_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{DATA}/conversations.parquet')")
    want = con.execute(f"SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM ({queries.ORACLE_SQL['op13_conversation_trie']})").fetchall()
    assert found(queries.op13_conversation_trie(spark, DATA)) == sorted(want, key=lambda r: r[:2])
