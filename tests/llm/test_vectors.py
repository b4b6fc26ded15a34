"""Embedding near-dedup against all pairs."""

import numpy as np
import pytest

from newsloom.llm import vectors


def brute(rows, threshold=0.95):
    fine = {i: np.array(v, np.float64) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(i for i, _ in rows)
    near = {i: {j for j in fine if i in fine and j != i and len(fine[i]) == len(fine[j]) and fine[i] @ fine[j] / np.linalg.norm(fine[i]) / np.linalg.norm(fine[j]) >= threshold} for i in ids}
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(near[i]), min(seen), min(seen) == i)
    return out


def made():
    r = np.random.default_rng(3)
    rows = []
    base = r.standard_normal((30, 24))
    for k in range(30):
        for _ in range(r.integers(1, 9)):
            v = base[k] / np.linalg.norm(base[k]) + r.standard_normal(24) * r.choice([0.0, 0.01, 0.03, 0.045])
            rows.append((v * r.choice([1.0, 1e-3, 50.0])).astype(np.float32).tolist())
    rows += [rows[0]] * 70  # copies
    chain = base[0].copy()
    for _ in range(40):  # near neighbours whose ends are far apart
        chain = chain + r.standard_normal(24) * 0.12
        rows.append(chain.astype(np.float32).tolist())
    rows += [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0], [1.0] * 24, [-1.0] * 24, [1e-30] * 24]
    ids = r.permutation(len(rows) * 3)[: len(rows)]
    return [(int(i), v) for i, v in zip(ids, rows, strict=True)]


def test_as_all_pairs(spark):
    rows = made()
    frame = spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id long, embedding array<float>, copies long, keys string")
    want = brute(rows)
    for block in (1024, 8):  # the smaller one splits buckets in blocks
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.classes(frame, block=block, recall=0.99999).collect()}
        assert got == want


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>"
    frame = spark.createDataFrame([(None, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.001]), (4, None)], schema)
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in vectors.classes(frame).collect())
    assert got == [("2", 2, "2", True), ("2", 2, "2", True), ("3", 2, "2", False), ("4", 0, "4", True), ("None", 0, "None", True)]
    assert vectors.classes(frame.limit(0)).count() == 0


def test_recall_at_the_threshold():
    r = np.random.default_rng(5)
    k, tables = vectors.plan(50_000)
    x = r.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.standard_normal((2000, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z
    a, b = (vectors.keys_of(v, k, tables, vectors.WIDTH, vectors.SEED) for v in (x, y))
    assert (a == b).any(axis=1).mean() >= 0.98
    assert (a == np.roll(b, 1, axis=0)).any(axis=1).mean() < 0.05


@pytest.mark.parametrize("chunk", [7, 1000])
def test_crowds(spark, monkeypatch, chunk):
    """Heavy buckets are compared by balls, of many chunks or one, and give the same links."""
    monkeypatch.setattr(vectors, "HEAVY", 2)
    monkeypatch.setattr(vectors, "SAMPLED", 1)
    r = np.random.default_rng(8)
    rows = made()
    hot = r.standard_normal(24)
    hot /= np.linalg.norm(hot)
    # a tight crowd, a wide one whose balls leave rows out, and strays between them
    rows += [(10_000 + i, (hot + r.standard_normal(24) * s).astype(np.float32).tolist()) for i, s in enumerate([0.01] * 60 + [0.03] * 60 + [0.045] * 60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in vectors.classes(frame, recall=0.99999, chunk=chunk).collect()}
    assert got == brute(rows)


def test_sketches_of_near_vectors():
    """No pair at the threshold is lost by its sketches; unrelated ones nearly all are."""
    r = np.random.default_rng(6)
    x = r.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.standard_normal((20_000, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    a, b = (vectors.sketches(v, vectors.SEED).view(np.uint64) for v in (x, 0.95 * x + np.sqrt(1 - 0.95**2) * z))
    apart = lambda p, q: np.bitwise_count(p ^ q).sum(axis=1)
    most = vectors.most_bits(0.95)
    assert (apart(a, b) <= most).all() and (apart(a, np.roll(b, 1, axis=0)) <= most).mean() < 0.001
