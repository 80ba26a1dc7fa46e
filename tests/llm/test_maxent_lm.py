import pickle
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from relevara.llm import maxent_lm as lm


def small_model(texts):
    words, cls, _ = lm.tokens(texts)
    keys, first, counts = np.unique(words, return_index=True, return_counts=True)
    trees = lm.Trees(keys, cls[first], counts, np.ones(lm.CLASSES))
    rng = np.random.default_rng(4)
    weights = rng.normal(size=(lm.LEAST_BUCKETS, lm.CLASSES)).astype(np.float32)
    tree = rng.normal(size=1 << lm.LEAST_BITS).astype(np.float32)
    return weights, rng.normal(size=lm.CLASSES).astype(np.float32), tree, trees


def test_training_tasks_add_into_arrays_of_numpys_own_dtype(monkeypatch):
    """Arrays that were sent have an equal dtype, but not numpy's object, and adding at places is then many times slower."""
    texts = pa.array(["one two three two one", None, "Two  three\tfour"] * 50)
    model = small_model(texts)
    sent = pickle.loads(pickle.dumps(model, protocol=5))
    seen, real = [], np.add.at

    class Add:
        def __getattr__(self, name):
            return getattr(np_add, name)

        def __call__(self, *args, **options):
            return np_add(*args, **options)

        def at(self, table, *args):
            seen.append(table.dtype)
            real(table, *args)

    np_add = np.add
    monkeypatch.setattr(lm, "np", SimpleNamespace(**{x: getattr(np, x) for x in dir(np) if not x.startswith("__")} | {"add": Add()}))
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    out = [list(lm.update_batches(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), *m)) for m in (model, sent)]
    assert out[0] == out[1] and len(out[0]) == 1
    assert seen and all(x is np.dtype(x.char) for x in seen)


def test_gradient_step_is_the_plain_one():
    texts = pa.array(["one two three two one", "two three four"] * 40)
    weights, bias, _, _ = small_model(texts)
    words, cls, off = lm.tokens(texts)
    f = lm.features(lm.histories(words, off), len(weights))
    p = np.exp(lm.log_softmax(weights, bias, f)).astype(np.float64)
    want = weights.astype(np.float64)
    for x in f:
        n = np.bincount(x, minlength=len(weights))
        for t, bucket in enumerate(x):
            want[bucket] += (np.eye(lm.CLASSES)[cls[t]] - p[t]) * lm.RATE / (n[bucket] + 2)
    lm.gradient_step(weights, bias, f, cls)
    assert np.allclose(weights, want, atol=1e-4)


def test_places_of_words_among_keys():
    rng = np.random.default_rng(5)
    last = np.uint64(2**64 - 1)
    close = np.uint64(7 << 60) + np.arange(100, dtype=np.uint64)  # of the same leading bits
    for keys in (np.zeros(0, np.uint64), np.array([0], np.uint64), np.array([last]), np.unique(rng.integers(0, 2**64, 5000, np.uint64)), np.concatenate([[np.uint64(3)], close, [last]])):
        words = np.concatenate([keys, keys + np.uint64(1), [np.uint64(0), last, last - np.uint64(1)], rng.integers(0, 2**64, 300, np.uint64)])
        at = {int(k): i for i, k in enumerate(keys)}
        assert lm.Places(keys)(words).tolist() == [at.get(int(w), -1) for w in words]
