"""Language ID: paths against all paths, spans, held-out accuracy."""

import itertools
import random

import numpy as np

from newsloom.llm import language

SCHEMA = "doc_id long, text string, lang string, score int"


def model(texts):
    from collections import Counter, defaultdict

    names = sorted({x for _, x in texts})
    by = defaultdict(lambda: [0] * len(names))
    for t, lang in texts:
        for w, n in Counter(t.split()).items():
            if low := language.letters(w):
                for c in low:
                    by["=" + language.script(c)][names.index(lang)] += n
                for g in language.grams(low):
                    by[g][names.index(lang)] += n
    return language.fitted(names, by)


TEXTS = [("the cat and the dog are on the mat with that other thing", "en"), ("der hund und die katze sind auf der matte mit dem anderen ding", "de"), ("кот и собака лежат на ковре вместе", "ru"), ("le chat et le chien sont sur le tapis avec une autre chose", "fr")]


def test_path_is_best():
    r = random.Random(1)
    scorer = language.Scorer(model(TEXTS), penalty=3.0)
    for _ in range(200):
        s = np.array([[r.choice([0.0, -1.0, -2.0, -5.0]) for _ in range(4)] for _ in range(r.randrange(1, 6))], np.float32)
        value = lambda p, s=s: sum(float(s[i, k]) for i, k in enumerate(p)) - 3.0 * sum(a != b for a, b in itertools.pairwise(p))
        best = max(map(value, itertools.product(range(4), repeat=len(s))))
        assert value(scorer.path(s).tolist()) == best
        one = scorer.one_language(s)
        if one is not None:
            assert abs(value([one] * len(s)) - best) < 1e-5


def test_scripts_and_spans(spark):
    docs = spark.createDataFrame([(1, "  the dog and the cat with the other thing " + "кот и собака лежат на ковре вместе кот", None, 5), (2, "Das 123", None, 5), (3, None, None, 5), (4, " 12 !? ", "en", 5), (5, "", None, 5), (6, "ковре", None, None)], SCHEMA)
    out = {r.doc_id: r for r in language.detect(docs, model(TEXTS)).collect()}
    assert [(x.lang, x.start, x.stop) for x in out[1].lang_spans] == [("en", 2, 42), ("ru", 43, 81)]
    assert out[6].lang_pred == "ru" and out[6].lang_spans[0].stop == 5
    assert all((out[k].lang_pred, out[k]._score, out[k].lang_spans) == ("und", 0.0, []) for k in (3, 4, 5))
    assert all(0 <= r._score <= 1 and r.score in (5, None) for r in out.values())
    kept = language.keep_identified(docs, model(TEXTS))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 6]


def test_held_out(spark, sf):
    out = language.query(spark, sf)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = out.collect()
    assert len(rows) == len(truth) and {r.held_out for r in rows} == {True, False}
    assert all(r.held_out == (language.remainder(r.doc_id, 4) == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None, 1)], SCHEMA)
    found = language.train(docs)
    assert [r.lang_pred for r in language.detect(docs, found).collect()] == ["und"]
    assert language.detect(docs.limit(0), found).count() == 0


def test_split_words_of_many_texts_are_not_held_at_once():
    import tracemalloc

    scorer = language.Scorer(model(TEXTS))
    texts = [b"the cat and the dog are on the mat with that other thing " * 40] * 1800  # 4 MB, what a worker takes at once
    one = scorer.labels(texts[:1])
    tracemalloc.start()
    try:
        found = scorer.labels(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == one * len(texts)
    assert peak < 16 << 20
