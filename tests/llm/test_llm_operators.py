"""Every operator against a brute-force version on a small fixture with the awkward cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from relevara.llm import maxent_lm, quality, queries
from relevara.llm.exact_dedup import exact_dedup
from relevara.llm.inner_product import norm_sorted_search
from relevara.llm.language_id import Parser, identify, suffix_automaton
from relevara.llm.mixing import mix
from relevara.llm.ngram_jaccard import jaccard_components
from relevara.llm.packing import minimum_bin_slack, pack
from relevara.llm.quality import accuracies, quality_scores
from relevara.llm.sanitise import find_spans, sanitised, span_text

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int"


def texts():
    rnd = random.Random(7)
    words = {"en": "the and of tion that with ing her for was".split(), "de": "der und die ein ung schön nicht keit über zu".split()}
    out = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        out.append((" ".join(rnd.choice(words[lang]) + rnd.choice(words[lang]) for _ in range(rnd.choice([1, 3, 5, 40, 200]))), lang))
    long = " ".join(f"w{rnd.randrange(500)}" for _ in range(3000))
    out += [(out[3][0], "en"), (out[3][0] + " \n", "en"), (out[4][0] + " tail", "en"), (None, "en"), (None, None), ("", "de"), ("  \t\n", None), (long, "en"), (long + " x", "en"), ("12 34 !! 56", "en")]
    out += [("mail a.b@c.de, a@b.c@d.ef x%y@z.w and 10.0.0.255 1.2.3.256 1.2.3.4.5.6.7.8 007.1.1.1", "en")]
    out += [("card 4111 1111 1111 1111 or 4111-1111-1111-1112 and +49 (30) 1234-5678 +1 2 +1((( 4111  1111", "en"), ("é\U0001f600 x@y.zz @ " + "1 " * 3000 + "a" * 5000 + "@" + "b." * 3000 + "c", "en")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, [None, "b", "a", "é"][i % 4], 0, "x", i) for i, (t, lang) in enumerate(texts())]
    rows += [rows[5], (None, "only words here", "en", "a", None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_exact_dedup(spark, docs, empty):
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = {}
    for d, t in rows:
        groups.setdefault(strip(t), []).append((-len(t or ""), d is None, d if d is not None else 0, d))
    for huge in (1 << 22, 64):  # also by the way of huge texts
        out = exact_dedup(spark, docs, huge).collect()
        assert len(out) == len(rows)
        by = {(r.doc_id, r.text_sha256): r for r in out}
        for d, t in rows:
            s = strip(t)
            r = by[d, hashlib.sha256(s.encode()).hexdigest()]
            assert (r.keep_id, r.group_size) == (min(groups[s])[3], len(groups[s]))
        assert sum(r.kept for r in out) == len(groups)
    assert rows_of(exact_dedup(spark, empty)) == []


def test_polynomial_fingerprints_compose():
    from relevara.llm.exact_dedup import CHUNK, fingerprint, power_table, shifted

    table, x = power_table(), np.random.default_rng(0).integers(0, 256, 3 * CHUNK + 17).astype(np.uint8)
    for cut in (CHUNK, 2 * CHUNK):
        assert fingerprint(x, table) == shifted(fingerprint(x[:cut], table), fingerprint(x[cut:], table), len(x) - cut)


def shingles(text, n):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def test_ngram_jaccard(spark, docs, empty):
    rnd, extra = random.Random(1), []
    base = [f"t{rnd.randrange(10**6)}" for _ in range(120)]
    for i in range(40):  # chains of near copies around the threshold
        base = base[:]
        for _ in range(rnd.choice([1, 2, 3])):
            base[rnd.randrange(len(base))] = f"n{rnd.randrange(10**6)}"
        extra.append((1000 + i, " ".join(base), "en", "a", 0, "x", 1))
    both = docs.union(spark.createDataFrame(extra, SCHEMA))
    rows = [(r.doc_id, r.text) for r in both.collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    for n, num, den in ((4, 85, 100), (2, 50, 100)):
        out = rows_of(jaccard_components(spark, both, n, num, den).select("doc_id", "n_shingles", "component_id"))
        assert sorted(out, key=key) == sorted(brute_components(rows, n, num, den), key=key)
    assert rows_of(jaccard_components(spark, empty)) == []


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary())
    out = pack(spark, docs, queries.vocabulary(), with_ids=True).toPandas()
    want = Counter()
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        cut = len(ids) % 1024 or 1024
        bounds = [0, *range(cut, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(itertools.pairwise(bounds)):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = Counter((None if pd.isna(d) else int(d), *x) for d, *x in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    assert got == want
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 1024
    assert all(len(i) == n for i, n in zip(out["ids"], out["length"], strict=True))
    bins = []  # no more sequences than first-fit decreasing needs
    for n in sorted(out["length"], reverse=True):
        at = next((i for i, b in enumerate(bins) if b + n <= 1024), None)
        bins.append(n) if at is None else bins.__setitem__(at, bins[at] + n)
    assert out["sequence_id"].nunique() <= len(bins)
    assert rows_of(pack(spark, empty, queries.vocabulary())) == []


@pytest.mark.parametrize("as_text", [False, True])
def test_packing_encoder_is_exact(as_text):
    from tokenizers import Tokenizer

    from relevara.llm.packing import Encoder

    tok = Tokenizer.from_file(queries.vocabulary())
    tok.encode_special_tokens = as_text
    enc = Encoder(open(queries.vocabulary(), encoding="utf-8").read(), as_text)
    rnd = random.Random(3)
    cases = ["".join(rnd.choice(["a", "b", "'s", " ", "\n", "\t", "!", "1", "é", " ", "\U0001f600", "<|endoftext|>", "'", " '"]) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    end = "<|endoftext|>"
    cases += [end, f"x {end} y", f"{end}{end}", f"{end} {end}", f"word{end}word", f" {end}", f"{end}\n{end} a"]
    if not as_text:
        assert np.frombuffer(enc.encode([f"x {end} y"])[0], "<u4").tolist() == [87, 220, 50256, 331]
    assert enc.encode(cases) == [np.array(tok.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in cases]


def test_minimum_bin_slack_removes_the_fullest_bin():
    rnd = random.Random(5)
    counts = Counter(rnd.choice([3, 4, 5, 6, 9, 11, 14, 17, 20]) for _ in range(60))
    left, used = counts.copy(), 0
    for bin_, times in minimum_bin_slack(dict(counts), 20):
        for _ in range(times):
            items = sorted(left.elements(), reverse=True)
            reach = {items[0]}
            for x in items[1:]:
                reach |= {r + x for r in reach if r + x <= 20}
            assert max(bin_) == items[0] and sum(bin_) == max(reach)
            left -= Counter(bin_)
            used += 1
    assert not left and used <= math.ceil(sum(k * n for k, n in counts.items()) / 20) + 1


def water_fill(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * level > 3 * sizes[s] or sizes[s] == 0}
        if not full:
            return out | {s: w[s] * level for s in free}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_mixing(spark, docs, empty):
    out = mix(spark, docs).toPandas()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = docs.collect()
    total = Counter()
    for r in rows:
        total[r.source] += size(r.text)
    goal = water_fill(dict(total))
    assert sorted(out["size"]) == sorted(size(r.text) for r in rows)
    for s, g in out.assign(source=[None if pd.isna(x) else x for x in out["source"]]).groupby("source", dropna=False):
        s = None if pd.isna(s) else s
        assert (g["source_size"] == total[s]).all() and np.allclose(g["target"], goal[s])
        assert abs(g["taken"].sum() - goal[s]) <= max(3, 0.1 * goal[s])
    assert (out["taken"] <= 3 * out["size"]).all() and (out["taken"] % out["size"].clip(lower=1) == 0).all()
    key = ["doc_id", "size", "source", "copies"]
    again = mix(spark, docs.repartition(3)).toPandas()
    assert out[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert rows_of(mix(spark, empty)) == []


def greedy_phrases(text, train):
    i = n = 0
    while i < len(text):
        size = 1
        while i + size < len(text) and text[i : i + size + 1] in train and text[i : i + size] in train:
            size += 1
        i, n = i + size, n + 1
    return n


def parser_of(train):
    models = []
    for k, t in enumerate(train):
        edges = suffix_automaton(t)
        flat = np.array([(i, c, j) for i, e in enumerate(edges) for c, j in e.items()], np.int32)
        models.append((str(k), len(t), len(edges), flat.tobytes()))
    return Parser(models)


def test_suffix_automaton_and_parse():
    rnd = random.Random(2)
    for _ in range(20):
        train = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 60))).encode() for _ in range(2)]
        text = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 300))).encode()
        got = parser_of(train).phrases(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        assert list(got) == [greedy_phrases(text, t) for t in train]


def test_parse_of_long_texts_is_one_parse():
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcde") for _ in range(n)).encode()
    train = [word(4000), word(3000) + b"zz" * 600]
    texts = [train[0], train[0][500:3700], train[1][7:] + word(900), word(5000), word(700) + train[1] + train[1][100:2900] + train[0][:2000], b"z" * 2600, b"", b"y" * 1500, train[0][:512] * 4, word(513), train[1][2000:4100]]
    off = np.cumsum([0, *map(len, texts)])
    got = parser_of(train).phrases(np.frombuffer(b"".join(texts), np.uint8), off)
    assert got.tolist() == [[greedy_phrases(x, t) for t in train] for x in texts]
    assert got[0, 0] == got[1, 0] == 1


def test_training_sample_takes_whole_texts():
    from relevara.llm.language_id import automaton_frame

    frame = lambda texts, most: automaton_frame(pd.DataFrame({"lang": "x", "order": range(len(texts)), "text": texts}), most).iloc[0]
    assert frame(["abc", "d" * 50, "ef"], 10).n_symbols == 7
    assert frame(["a" * 30, "b" * 20], 10).n_symbols == 10


def test_language_id(spark, docs, empty):
    out = identify(spark, docs, F.lit(True), ["doc_id", "lang"]).collect()
    letters = {r.doc_id: bool(re.search(r"[^\W\d_]", r.text or "")) for r in docs.filter("doc_id IS NOT NULL").collect()}
    assert len(out) == docs.count()
    for r in out:
        assert 0 <= r.score <= 1 and (r.doc_id is None or (r.lang_pred == "und") == (not letters[r.doc_id]))
    assert sorted(r.lang_pred for r in out if r.doc_id is None) == ["en", "und"]
    good = [r.lang == r.lang_pred for r in out if r.doc_id is not None and r.doc_id < 60]
    assert sum(good) >= 57
    assert {r.lang_pred for r in identify(spark, docs, F.lit(False)).collect()} == {"und"}
    assert rows_of(identify(spark, empty, F.lit(True))) == []


def test_language_id_on_held_out_documents(spark):
    out = queries.op7_language_id(spark, DATA).toPandas()
    real = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").toPandas()
    both = out.merge(real, on="doc_id")
    held = both[both["held_out"]]
    assert len(out) == len(real) and (held["lang"] == held["lang_pred"]).mean() >= 0.95
    assert (both["held_out"] == [zlib.crc32(str(d).encode()) % 4 == 2 for d in both["doc_id"]]).all()


def low_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


@pytest.mark.parametrize("common", [4, 1 << 18])
def test_lm_base_scores(spark, docs, common):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    out = maxent_lm.maxent_scores(spark, docs, held, common).collect()
    rows = [(r.doc_id, low_words(r.text), zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 7 == 2) for r in docs.collect()]
    c = Counter(w for _, ws, h in rows if not h for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    want = sorted((d is None, d or 0, h, len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*ws, None]), 6)) for d, ws, h in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 for r in out)


def test_lm_model_is_a_distribution_and_beats_the_base(spark, empty):
    out = queries.op8_lm_scoring(spark, DATA).toPandas()
    held = out[out["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()
    rng = np.random.default_rng(0)
    w, b = rng.normal(size=(maxent_lm.BUCKETS, maxent_lm.CLASSES)).astype(np.float32), rng.normal(size=maxent_lm.CLASSES).astype(np.float32)
    f = rng.integers(0, maxent_lm.BUCKETS, (4, 10))
    assert np.allclose(np.exp(maxent_lm.log_softmax(w, b, f)).sum(1), 1, atol=1e-4)
    assert rows_of(maxent_lm.maxent_scores(spark, empty, F.lit(False))) == []


@pytest.mark.parametrize("common", [4, 1 << 18])
def test_lm_history_tells_words_of_a_class_apart(spark, common):
    rnd = random.Random(3)
    pair = lambda i, j: f"head{i}aa tail{j}zz"
    say = lambda by: " ".join(pair(i, (i + by) % 12) for i in rnd.choices(range(12), k=60))
    df = spark.createDataFrame([(d, say(0) if d < 350 else say(5)) for d in range(400)], "doc_id long, text string")
    out = {r.doc_id: r.score for r in maxent_lm.maxent_scores(spark, df, F.col("doc_id") >= 300, common).collect()}
    assert min(out[d] for d in range(300, 350)) > max(out[d] for d in range(350, 400)) + 5


def test_lm_symbols_of_a_class_sum_to_one():
    rng = np.random.default_rng(2)
    words, cls, counts, rest = rng.integers(0, 2**64, 300, np.uint64), rng.integers(1, maxent_lm.CLASSES, 300), rng.integers(1, 999, 300), rng.integers(1, 99, maxent_lm.CLASSES).astype(float)
    trees = maxent_lm.Trees(words, cls, counts, rest)
    symbols = np.concatenate([trees.symbols(words, cls), trees.symbols(np.arange(maxent_lm.CLASSES, dtype=np.uint64), np.arange(maxent_lm.CLASSES))])
    owner, mass = np.concatenate([cls, np.arange(maxent_lm.CLASSES)]), np.concatenate([counts, rest])
    h = np.repeat(rng.integers(0, 2**64, (4, 1), np.uint64), len(symbols), 1)
    p = np.exp(maxent_lm.tree_logs(trees, rng.normal(size=1 << 16).astype(np.float32), symbols, h))
    assert len(set(symbols)) == len(symbols) and np.allclose(np.bincount(owner, p), 1, rtol=1e-3)
    flat = np.exp(maxent_lm.tree_logs(trees, np.zeros(1 << 16, np.float32), symbols, h))
    assert np.allclose(flat, mass / np.bincount(owner, mass)[owner], rtol=1e-3)


@pytest.mark.parametrize("candidates", [0, 3, 1 << 13])
def test_lm_probabilities_of_all_words_sum_to_one(spark, candidates):
    """Whatever the candidates, the known words and one unknown of each class make up the whole after any history."""
    rnd = random.Random(8)
    vocabulary = [f"w{i}{rnd.choice('abc')}{rnd.choice('xy')}" for i in range(30)]
    train = [(d, " ".join(rnd.choices(vocabulary, k=20))) for d in range(60)]
    df = spark.createDataFrame([*train, *((1000 + i, w) for i, w in enumerate(vocabulary))], "doc_id long, text string")
    out = {r.doc_id: r.score for r in maxent_lm.maxent_scores(spark, df, F.col("doc_id") >= 1000, candidates=candidates).collect()}
    assert 0 < sum(10 ** out[1000 + i] for i in range(30)) < 1


def test_exact_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.choice([0.1, 1, 3])]) for i in range(3000)]
    rows += [(4000 + i, rows[7][1]) for i in range(40)] + [(5000, None), (5100, [1.0, None]), (5200, [math.nan] * 8), (5300, []), (5400, [1.0, 2.0]), (None, [1.0]), (5500, [1e300] * 8), (5600, [math.inf])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in ints:
        if q % 100 == 0:
            s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(ints[q], x)))), i) for i, x in ints.items() if i != q)[:10]
            want += [(q, k + 1, i, -v) for k, (v, i) in enumerate(s)]
    out = rows_of(norm_sorted_search(spark, df, F.col("vec_id") % 100 == 0))
    assert sorted(out) == sorted(want)
    assert rows_of(norm_sorted_search(spark, df.limit(0), F.col("vec_id") % 100 == 0)) == []


def test_top_k_scores_few_pairs_of_clustered_vectors():
    from relevara.llm.inner_product import search_block

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64))
    x = np.floor(1024 * (centres[rng.integers(0, 40, 1024)] + 0.05 * rng.normal(size=(1024, 64))))
    q, ids = x[:50], np.arange(1024)
    rotation = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    scores = q @ x.T
    scores[np.arange(50), np.arange(50)] = -np.inf
    floor = np.sort(scores, 1)[:, -10]
    qi, vi, s, n = search_block(ids[:50], q, floor, ids, x, rotation, 10)
    assert n < 0.1 * 50 * 1024
    want = [(i, j, scores[i, j]) for i in range(50) for j in np.lexsort((ids, -scores[i]))[:10]]
    assert sorted(zip(qi, vi, s, strict=True)) == sorted(want)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    t, out = t or "", []
    for k, (name, p) in enumerate({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if name == "email" or name == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or name == "card" and 14 <= len(d) <= 19 and luhn(d) or name == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii_base_spans(spark, docs, empty):
    rnd = random.Random(4)
    odd = [("".join(rnd.choice(["1", "22", "4111 1111 1111 1111", " ", "-", ".", "@", "a", "+", "(", "é", "b-c", "%", "", "10.1.1.1", "+49 301234567"]) for _ in range(30)),) for _ in range(400)]
    real = spark.read.parquet(f"{DATA}/documents.parquet").select("text")
    both = docs.select("text").union(spark.createDataFrame(odd, "text string")).union(real)
    both = spark.createDataFrame([(i, r.text) for i, r in enumerate(both.collect())], "doc_id long, text string")
    out = {r.doc_id: r.b for r in find_spans(spark, both).select("doc_id", span_text(F.col("base")).alias("b")).collect()}
    for r in both.collect():
        assert out[r.doc_id] == brute_spans(r.text), r.text[:200]
    assert rows_of(find_spans(spark, empty)) == []


def test_pii_terms_that_reveal(spark):
    rnd = random.Random(6)
    common = [f"word{i}" for i in range(30)]
    say = lambda: " ".join(rnd.choice(common) for _ in range(12))
    rows = [(i, f"{say()} kestrelman writes to bob@corp.example about {rnd.choice(common)} {say()}") for i in range(8)]
    rows += [(100 + i, f"{say()} ask eve{i}@corp.example {say()}") for i in range(60)] + [(200 + i, say()) for i in range(200)]
    rows += [(500 + i, f"gyrfalcons alone bob@corp.example {rnd.random()}") for i in range(1)] + [(900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = find_spans(spark, df)
    out = {r.doc_id: r.s for r in spans.select("doc_id", span_text(F.col("all")).alias("s")).collect()}
    for i, t in rows[:8]:
        at = t.index("kestrelman")
        assert f"term:{at}:{at + 10}" in out[i]
    assert all("term" not in s for d, s in out.items() if d >= 100)
    clean = {r.doc_id: r.text for r in sanitised(df, spans).collect()}
    assert clean[900] is None and all("<EMAIL>" in clean[i] and "kestrelman" not in clean[i] and "bob@" not in clean[i] for i in range(8))


def test_pii_terms_count_distinct_texts(spark):
    rnd = random.Random(8)
    say = lambda: " ".join(f"word{rnd.randrange(40)}" for _ in range(20))
    copied = [f"{say()} peregrine wrote zed@corp.example {say()}" for _ in range(3)]
    same = "stand very long and always equal words before it merlinella uma@corp.example and as many equal words that stand behind it"
    rows = [*copied, *[copied[0]] * 30, *[f"{say()} {same} {say()}" for _ in range(4)], *[say() for _ in range(300)]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: r.s for r in find_spans(spark, df).select("doc_id", span_text(F.col("all")).alias("s")).collect()}
    for i, t in enumerate(rows[:37]):
        at, end = re.search("peregrine|merlinella", t).span()
        assert f"term:{at}:{end}" in out[i]
    assert not any(out[i] for i in range(37, len(rows)))


def test_pii_terms_anywhere_in_all_texts(spark):
    rnd = random.Random(9)
    say = lambda n=30: " ".join(f"word{rnd.randrange(40)}" for _ in range(n))
    rows = [f"Ospreyson {say()} kim@corp.example {say()} \ue003m OSPREYSON\ue003 ospreyson" for _ in range(6)]
    rows += [f"{say()} ospreyson {say()}\n ospreyson's", *[say() for _ in range(300)]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    spans = find_spans(spark, df)
    out = {r.doc_id: r.s.split(",") for r in spans.select("doc_id", span_text(F.col("all")).alias("s")).collect()}
    for i, t in enumerate(rows[:7]):
        want = {f"term:{m.start()}:{m.end()}" for m in re.finditer(r"\S+", t) if m[0].lower() in ("ospreyson", "ospreyson\ue003")}
        assert {x for x in out[i] if x.startswith("term")} == want
    assert all(out[i] == [""] for i in range(7, len(rows)))
    clean = {r.doc_id: r.text for r in sanitised(df, spans).collect()}
    assert not any(re.search(r"(?i)\bospreyson(?!')", t) for t in clean.values())


def test_quality(spark, docs, empty):
    out = {r.doc_id: r.score for r in quality_scores(spark, docs).collect()}
    assert len(out) == docs.select("doc_id").distinct().count() and all(0 <= s <= 1 for s in out.values())
    assert rows_of(quality_scores(spark, empty)) == []


def plain_measures(text):
    b = (text or "").encode()
    letters, capitals = sum(chr(c).islower() and c < 128 or c > 127 for c in b), sum(chr(c).isupper() and c < 128 for c in b)
    words = low_words(text)
    size, total = max(sum(c not in b" \t\n\x0b\x0c\r" for c in b), 1), max(len(words), 1)
    symbols, ends = sum(chr(c) in "!\"#$%&*+/:;<=>@[\\]^_`{|}~" for c in b), b.count(b".") + b.count(b"?")
    every = letters + capitals
    return [every / size, symbols / size, capitals / max(every, 1), sum(48 <= c < 58 for c in b) / size, size / total, min(1.0, len(set(words)) / max(1.0, total**0.85)), ends / total, float(len(words))]


def plain_votes(text):
    out = []
    for x, (a, b, c, d) in zip(plain_measures(text), quality.HEURISTICS.values(), strict=True):
        out.append(0 if x < a or x > d else 1 if b <= x <= c else 2)
    return tuple(out)


def test_quality_against_a_plain_version(spark, docs, monkeypatch):
    """Votes, posteriors and scores, each by plain loops; a second run gives the same scores."""
    sent, posted, broadcast, fit = [], [], type(spark.sparkContext).broadcast, quality.accuracies
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(x) or broadcast(self, x))
    monkeypatch.setattr(quality, "accuracies", lambda patterns, n: posted.append((patterns, n, fit(patterns, n))) or posted[-1][2])
    long = spark.createDataFrame([(900, "word " * 60_000 + "End.", "en", "a", 0, "x", 1), (901, "A" * 200_000, "en", "a", 0, "x", 1)], SCHEMA)
    table = docs.union(long)
    got = quality_scores(spark, table).collect()
    rows = table.collect()
    patterns, n, (post, acc, prior) = posted[0]
    counts = Counter(sum(v * 3**j for j, v in enumerate(plain_votes(r.text))) for r in rows if low_words(r.text))
    assert dict(zip(patterns.tolist(), n.astype(int).tolist(), strict=True)) == counts
    # one more round of expectation and maximisation by loops leaves the posteriors where they are
    v = {p: [p // 3**j % 3 for j in range(8)] for p in patterns.tolist()}
    for p, have in zip(patterns.tolist(), post, strict=True):
        up, down = math.log(prior), math.log(1 - prior)
        for j, x in enumerate(v[p]):
            if x < 2:
                up += math.log(acc[1][j] if x else 1 - acc[1][j])
                down += math.log(1 - acc[0][j] if x else acc[0][j])
        assert abs(1 / (1 + math.exp(down - up)) - have) < 1e-9
    for c in (0, 1):
        for j in range(8):
            mass = {p: (q if c else 1 - q) * counts[p] for p, q in zip(patterns.tolist(), post, strict=True)}
            right, all_ = sum(m for p, m in mass.items() if v[p][j] == c), sum(m for p, m in mass.items() if v[p][j] < 2)
            assert abs(min(0.98, max(0.05, (right + 2) / (all_ + 3))) - acc[c][j]) < 0.02
    weights = [x for x in sent if isinstance(x, np.ndarray)][-1]
    half = quality.BUCKETS - 512
    for r in got:
        text = {(x.doc_id): x.text for x in rows if x.doc_id is not None}.get(r.doc_id) if r.doc_id is not None else None
        words = low_words(text)
        if r.doc_id is None or not words or r.doc_id > 60:
            continue
        z = weights[-1]
        for w, k in Counter(words).items():
            h = int(quality.word_hashes(*quality.buffers(quality.pa.array([w])))[0][0])
            z += weights[h % half] * k / len(words)
        for j, (x, (_, _, _, hi)) in enumerate(zip(plain_measures(text), quality.HEURISTICS.values(), strict=True)):
            edges = np.linspace(0, 1, 15)[1:] if hi <= 1.1 else np.geomspace(1, max(2.0, min(hi, 1e5)), 14)
            band = sum(math.sqrt(e) < math.sqrt(x) for e in edges) if edges[-1] <= 1.1 else sum(e < x for e in edges)
            z += 0.25 * weights[half + j * 32 + band]
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
    again = quality_scores(spark, table.repartition(3)).collect()
    assert sorted((r.doc_id or -1, r.score) for r in again) == sorted((r.doc_id or -1, r.score) for r in got)


def test_quality_ranks_labelled_documents(spark):
    data = DATA.replace("0.001", "0.01")
    out = queries.op1_quality_classifier(spark, data).toPandas()
    both = out.merge(spark.read.parquet(f"{data}/labels.parquet").toPandas(), on="doc_id")
    rank, good = both["score"].rank(), both["quality"] == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.9 and (both["good"][good]).mean() > 0.9


def test_quality_runs_all_rounds(spark, docs, monkeypatch):
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(x) or broadcast(self, x))
    quality_scores(spark, docs)
    weights = [x for x in sent if isinstance(x, np.ndarray)]
    assert len(weights) == quality.PASSES + 1 and all((a != b).any() for a, b in itertools.pairwise(weights))


def test_em_finds_a_bad_labeller():
    rng = np.random.default_rng(0)
    from relevara.llm.quality import HEURISTICS

    truth = rng.random(20000) < 0.7
    acc = np.array([0.9, 0.9, 0.85, 0.9, 0.8, 0.9, 0.85, 0.55])[: len(HEURISTICS)]
    v = np.where(rng.random((20000, len(acc))) < acc, truth[:, None], ~truth[:, None]).astype(int)
    patterns, n = np.unique(v @ 3 ** np.arange(len(acc)), return_counts=True)
    post, found, prior = accuracies(patterns, n.astype(float))
    assert abs(prior - 0.7) < 0.05 and found[1][-1] < 0.7 < found[1][0]


def test_pipeline_stages(spark, docs, empty):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, DATA)
        assert out.columns == docs.columns and stage(spark, empty, DATA).count() == 0, name
        now = spark.createDataFrame(out.collect(), SCHEMA)
        if name == "language_id":
            assert {r.doc_id for r in now.collect()} == {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}
        if name == "exact_dedup":
            assert len({re.sub(r"\s", "", r.text) for r in now.collect()}) == now.count()
        if name == "ngram_jaccard_join":
            rows = [(r.doc_id, r.text) for r in now.collect()]
            assert all(d == c for d, _, c in brute_components(rows, 5, 80, 100))
    assert now.count() > 0 and stage(spark, empty, DATA) is not None


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, DATA).toPandas()
    assert out.groupby("sequence_id")["length"].sum().max() <= 1024 and len(out) > 100
