"""Near-dedup against all pairs."""

import random

from newsloom.llm import minhash
from newsloom.llm.common import components


def brute(rows, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            n = len(sets[a] & sets[b])
            if sets[a] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n) and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def made(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out, base = [], [r.choices(vocab, k=r.randint(30, 300)) for _ in range(12)]
    for b in base:
        now = b
        for _ in range(r.randint(1, 40)):  # chains: each copy of the copy before, with a few words changed
            now = list(now)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                now[r.randrange(len(now))] = r.choice(vocab)
            out.append(" ".join(now) if r.random() < 0.7 else "\n\t".join(now).upper())
    out += ["", None, " \n", "a", "A", "a b", "a b c d", "a b c d e", "A B C D E", "ß Ä", "ß ä", " ", "x " * 30000, "x " * 29999]
    r.shuffle(out)
    return [(i * 7 % 1009, t) for i, t in enumerate(out)]


def test_as_all_pairs(spark):
    for seed, percent in ((1, 85), (2, 80)):
        rows = made(seed)
        docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bands string")
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.classes(docs, percent=percent).collect()}
        assert got == brute(rows, percent)
        kept = minhash.dedup(docs, percent=percent)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in got.items() if v[2])


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f"), (6, None)], schema)
    out = minhash.classes(docs).collect()
    assert len(out) == 5 and {(r.doc_id, r.component_id, r.kept) for r in out} == {(None, None, True), (3, 3, True), (5, 3, False), (6, 6, True)}
    assert sorted(str(r.doc_id) for r in minhash.dedup(docs).collect()) == ["3", "6", "None"]
    assert minhash.classes(docs.limit(0)).count() == 0 and minhash.dedup(docs.limit(0)).count() == 0


def test_one_id_with_several_texts(spark):
    """No text is lost where rows share a doc_id, and what stays is not a copy."""
    a, b = " ".join(f"q{i}" for i in range(60)), " ".join(f"r{i}" for i in range(60))
    docs = spark.createDataFrame([(1, a, 1), (2, a, 2), (2, b, 3), (2, b, 4), (3, None, 5), (3, None, 6)], "doc_id long, text string, text_a int")
    assert sorted((r.doc_id, r.text or "") for r in minhash.dedup(docs).collect()) == [(1, a), (2, b), (3, "")]


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + r.randrange(60), 1000 + r.randrange(60)) for _ in range(45)] + [(None, 1), (5, None), (7, 7)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201))
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert got[n] == min(seen)
    assert set(got) == set(near)


def test_two_partners(spark):
    """A center with two near copies that are not linked to each other; some pairs share only buckets of two members."""
    r = random.Random(11)
    rows = []
    for i in range(150):
        center = [f"t{i}w{k}" for k in range(104)]
        rows.append((3 * i, " ".join(center)))
        for side in (0, 1):  # ten changed shingles at one end or the other: 0.82 with the center, 0.67 with each other
            words = list(center)
            for k in range(10):
                words[k if side else -1 - k] = f"x{r.random()}"
            rows.append((3 * i + 1 + side, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in minhash.classes(docs, percent=80).collect()}
    assert got == {i: i - i % 3 for i, _ in rows}
