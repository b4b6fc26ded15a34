"""Decontamination against plain edit distance."""

import random

from newsloom.llm import contamination as c


def least_distance(item, text):
    """The smallest edit distance of item to any stretch of text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for x in text:
        last, row[0] = row[0], 0
        for i, y in enumerate(item):
            last, row[i + 1] = row[i + 1], min(row[i] + 1, row[i + 1] + 1, last + (x != y))
        best = min(best, row[-1])
    return best


def changed(r, text, n):
    t = list(text)
    for _ in range(n):
        k = r.randrange(len(t))
        r.choice([lambda: t.__setitem__(k, r.choice("xyz ")), lambda: t.pop(k), lambda: t.insert(k, r.choice("xyz"))])()
    return "".join(t)


def made(seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(200)]
    say = lambda n: " ".join(r.choices(words, k=n))
    items = [(i, say(r.randrange(1, 40))) for i in range(25)] + [(90, ""), (91, None), (92, "  "), (93, "ab"), (94, "Ähnlich  wie DAS\nhier steht und noch etwas mehr 😀 dazu")]
    items.append((95, items[0][1]))
    docs = []
    for i in range(60):
        body = say(r.randrange(0, 60))
        for _ in range(r.randrange(3)):
            key, item = r.choice(items[:25])
            body += " " + changed(r, item, r.choice([0, 0, 1, len(item) // 20, len(item) // 10, len(item) // 8])) + " " + say(r.randrange(5))
        docs.append((i, r.choice([str, str.upper])(body)))
    return docs + [(100, None), (101, ""), (102, "x ähnlich wie das hier steht und noch ETWAS mehr 😀 dazu x"), (103, " ".join(words) * 40)], items


def brute(docs, items):
    out = {}
    for i, t in docs:
        text = c.normal(t)
        for key, raw in items:
            item = c.normal(raw)
            if item and len(text) and (d := least_distance(item, text)) <= c.budget(len(item)):
                out[i, key] = d
    return out


def test_as_edit_distance(spark):
    docs, items = made(4)
    want = brute(docs, items)
    assert len({d for d in want.values()}) > 3
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (8 << 20, 300):
        got = c.matches(frame, bench, block_chars=most).collect()
        assert {(r.doc_id, r.item_id): r.distance for r in got} == want
        texts, wanted = dict(docs), dict(items)
        for r in got:
            assert least_distance(c.normal(wanted[r.item_id]), c.normal(texts[r.doc_id])[r.start : r.stop]) == r.distance
        kept = c.clean(frame, bench, block_chars=most, shortest=1)
        assert kept.columns == frame.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _ in docs} - {i for i, _ in want})


def test_empty(spark):
    docs = spark.createDataFrame([(1, "some words"), (1, "some words")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert c.matches(docs, none).count() == 0 and c.clean(docs, none).count() == 2
    assert c.matches(docs.limit(0), none).count() == 0
    some = spark.createDataFrame([(7, "some words")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.distance) for r in c.matches(docs, some).collect()] == [(1, 7, 0)] * 2


def test_everything_in_the_data(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    exact = {(r.doc_id, b.item_id) for r in docs.collect() for b in bench.collect() if c.normal(b.text) in c.normal(r.text)}
    got = {(r.doc_id, r.item_id) for r in c.query(spark, sf).collect()}
    assert exact and exact <= got


def test_short_items_empty_no_corpus(spark):
    """An item of a letter or a word is found by matches, but is no reason for clean to drop a document."""
    docs = spark.createDataFrame([(1, "a banana"), (2, "long enough to be a real passage, yes")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a"), (2, "Long  enough to be a real passage")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in c.matches(docs, bench).collect()) == [(1, 1), (2, 1), (2, 2)]
    assert [r.doc_id for r in c.clean(docs, bench).collect()] == [1]


def test_long_text(spark):
    """A passage at the end of a text of a megabyte."""
    item = "the quick brown fox jumps over the lazy dog and runs along the river"
    text = "word " * 220_000 + item.replace("lazy", "laxy")
    got = c.matches(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r.item_id, r.distance) for r in got] == [(5, 1)]
