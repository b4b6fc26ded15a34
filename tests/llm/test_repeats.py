"""Substring dedup against the definition."""

import hashlib
import random

import numpy as np

from newsloom.llm import repeats


def brute(rows, window):
    words = {i: (t or "").encode().split() for i, t in rows if i is not None}
    least = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            least.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = {p for k in range(len(w) - window + 1) if least[tuple(w[k : k + window])] < i for p in range(k, k + window)}
        out[i] = (len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode())
    return out


def made(seed):
    r = random.Random(seed)
    vocab = ["é", "a", "b", "ç\xa0d", "e.", "日本"] + [f"w{i}" for i in range(200)]
    passages = [r.choices(vocab, k=r.choice([49, 50, 51, 70, 120])) for _ in range(6)]
    rows = []
    for i in range(120):
        t = []
        for _ in range(r.randrange(5)):
            t += r.choice([lambda: r.choices(vocab, k=r.randrange(80)), lambda: r.choice(passages), lambda: ["a"] * r.randrange(70)])()
        rows.append((r.randrange(10**12) if i % 2 else i, r.choice([" ", "\n", "\t \r\x0b\x0c"]).join(t) if t else r.choice(["", None, " "])))
    return rows + [(5000, "x " * 20000), (5001, "x " * 49), (5002, "x " * 50)]


def test_as_defined(spark):
    for seed in (1, 2):
        rows = made(seed)
        docs = spark.createDataFrame([(i, t, "old") for i, t in rows], "doc_id long, text string, removed string")
        want = brute(rows, 50)
        for r in repeats.dedup(docs).collect():
            assert (r.n_words, r.n_removed, r.kept_text) == want[r.doc_id] and r.removed == "old"
            assert sum(z - a for a, z in r._removed) == r.n_removed
        for r in repeats.dedup(docs, digest=True).collect():
            assert r.kept_sha256 == hashlib.sha256(want[r.doc_id][2].encode()).hexdigest()


def test_odd_rows(spark):
    text = " ".join(f"q{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (9, text)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in repeats.dedup(docs).collect()) == [("4", 0), ("4", 0), ("9", 60), ("None", 0)]
    assert repeats.dedup(docs.limit(0)).count() == 0


def test_one_id_with_several_texts(spark):
    """Rows that share a doc_id lose the words of their own text only, and none for each other."""
    text, other = " ".join(f"q{i}" for i in range(60)), " ".join(f"r{i}" for i in range(200))
    rows = [(1, text), (2, text), (2, other), (2, "x " + text + " " + other), (3, other), (3, "short"), (3, None), (3, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in repeats.dedup(docs).collect())
    tail = "x " + other
    assert got == sorted([(1, 60, 0, text), (2, 60, 60, ""), (2, 200, 0, other), (2, 261, 60, tail), (3, 200, 200, ""), (3, 200, 200, ""), (3, 1, 0, "short"), (3, 0, 0, "")])


def test_rolling_and_packing():
    h = np.random.default_rng(1).integers(0, 1 << 63, 300).astype(np.uint64)
    for window in (1, 2, 3, 5, 8, 49, 50, 300):
        out = repeats.rolling(h, window)
        assert len(out) == 300 - window + 1
        again = repeats.rolling(h[7 : 7 + window], window) if window < 290 else out[:1]
        assert again[0] == (out[7] if window < 290 else out[0])
    assert repeats.intervals(np.array([0, 3, 53, 104], np.uint32), 50) == [(0, 103), (104, 154)]
