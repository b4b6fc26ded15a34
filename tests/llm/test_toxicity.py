"""Toxicity: restored words, held-out accuracy."""

import random
import time
import zlib

from newsloom.llm import toxicity

SCHEMA = "doc_id long, text string, score string"
CLEAN = "the weather is fine today and we walk along the river with our friends while birds sing in trees near water".split()
BAD = ["idiot", "moron", "stupid"]


def made(n, seed, disguise):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = r.choices(CLEAN, k=r.randrange(20, 60))
        toxic = int(r.random() < 0.3)
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), disguise(r, r.choice(BAD)))
        rows.append((i, " ".join(words), "old"))
        labels.append((i, toxic))
    return rows, labels


def hidden(r, w):
    return r.choice([lambda: w.replace("i", "1").replace("o", "0"), lambda: w.replace("s", "$").replace("i", "!").upper(), lambda: " ".join(w), lambda: ".".join(w), lambda: w.replace(w[2], w[2] * 4), lambda: w + "!!!"])()


def test_disguises(spark):
    rows, labels = made(600, 1, lambda r, w: hidden(r, w) if r.random() < 0.3 else w)
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known.where("doc_id % 3 <> 0"))
    assert set(BAD) <= set(model["weights"])
    scorer = toxicity.Scorer(model["counts"], model["weights"], model["model"])
    for token, want in ((b"1d10t", "idiot"), (b"m0r0n", "moron"), (b"$tupid", "stupid"), (b"i.d.i.o.t", "idiot"), (b"stuuuupid", "stupid"), (b"IDIOT!!!", "idiot"), (b"r1ver", "river"), (b"(friends),", "friends")):
        assert want in scorer.words(token), (token, scorer.words(token))
    assert scorer.channel.restore("idiot", True) == ["idiot"]
    # in documents never trained on, all bad words disguised
    test, truth = made(300, 2, hidden)
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(test, SCHEMA), model).collect()}
    right = sum(got[i].predicted == t for i, t in truth)
    assert right >= 0.95 * len(truth)
    assert all(0 <= r._score <= 1 and r.score == "old" for r in got.values())


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", None), (3, " ", None), (3, " ", None), (None, "idiot", None), (5, "x" * 100_000 + " 1" * 1000, None), (6, "ß日本 $$$ 123 @@", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and {r.predicted for r in got} == {0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_held_out(spark):
    out = toxicity.query(spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(truth[r.doc_id] == r.predicted for r in held) >= 0.9 * len(held)


def test_doubled_letters(spark):
    """One doubled letter disguises a word; a word that has one by right stays as it is, too."""
    rows, labels = made(600, 1, lambda r, w: hidden(r, w) if r.random() < 0.3 else w)
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    scorer = toxicity.Scorer(model["counts"], model["weights"], model["model"])
    for token, want in ((b"stuupid", "stupid"), (b"iidiot", "idiot"), (b"mooron", "moron"), (b"IDIOTT", "idiot"), (b"trees", "trees")):
        assert want in scorer.words(token), (token, scorer.words(token))
    assert all(scorer.token(t) > 0 for t in (b"iidiot", b"mooron"))


def brute(channel, token, gaps):
    """The best path of all through the lattice: every choice of arcs, scored letter by letter."""
    paths = [("", 0.0, "", toxicity.BEGIN, "")]  # text, score, two letters before, character before
    for ch in token.lower():
        more = []
        for text, score, a, b, before in paths:
            if ch.isalpha():
                arcs = [(ch, toxicity.SAME)] + ([("", toxicity.REPEAT_DROPPED)] if ch == before else [])
            else:
                arcs = [(x, toxicity.IMITATED) for x in toxicity.LEET.get(ch, "")]
                arcs.append(("", toxicity.NOISE_DROPPED if ch in toxicity.NOISE else toxicity.REPEAT_DROPPED if ch == before else toxicity.DROPPED))
            for letter, cost in arcs:
                if not letter:
                    more.append((text, score + cost, a, b, ch))
                    continue
                more.append((text + letter, score + cost + (channel.log(a, b, letter) if a else channel.start(letter)), b, letter, ch))
                if gaps and a:
                    more.append((text + " " + letter, score + cost + toxicity.GAP + channel.log(a, b, toxicity.END) + channel.start(letter), toxicity.BEGIN, letter, ch))
        paths = more
    return max((score + (channel.log(a, b, toxicity.END) if a else -50.0), text) for text, score, a, b, _ in paths)


def test_restore_is_the_best_path(spark):
    """Viterbi against every path through the lattice."""
    docs = spark.createDataFrame([(i, " ".join([*CLEAN, *BAD])) for i in range(3)], "doc_id long, text string")
    channel = toxicity.Channel({r["gram"]: r["n"] for r in toxicity.letter_counts(docs).collect()})
    r = random.Random(3)
    tokens = ["1d10t", "m0r0n", "$tu.p1d", "iidd", "r!v3r", "w@lk", "8", "...", "a", "é1", "(h1ll"]
    tokens += ["".join(r.choices("aeiorstdw013$!@.-", k=r.randrange(1, 7))) for _ in range(150)]
    for token in tokens:
        for gaps in (False, True):
            got = channel.restore(token, gaps)
            best, text = brute(channel, token, gaps)
            assert got == text.split() or _score(channel, token, gaps, got) >= best - 1e-9, (token, got, text)


def _score(channel, token, gaps, words):
    """The best score of the paths that spell these words."""
    want = " ".join(words)
    paths, out = {("", "", toxicity.BEGIN): 0.0}, -1e9
    before = ""
    for ch in token.lower():
        arcs = [(ch, toxicity.SAME)] + ([("", toxicity.REPEAT_DROPPED)] if ch == before else []) if ch.isalpha() else [(x, toxicity.IMITATED) for x in toxicity.LEET.get(ch, "")] + [("", toxicity.NOISE_DROPPED if ch in toxicity.NOISE else toxicity.REPEAT_DROPPED if ch == before else toxicity.DROPPED)]
        now = {}
        for (text, a, b), score in paths.items():
            for letter, cost in arcs:
                steps = [((text, a, b), score + cost)] if not letter else [((text + letter, b, letter), score + cost + (channel.log(a, b, letter) if a else channel.start(letter)))]
                if letter and gaps and a:
                    steps.append(((text + " " + letter, toxicity.BEGIN, letter), score + cost + toxicity.GAP + channel.log(a, b, toxicity.END) + channel.start(letter)))
                for key, value in steps:
                    if want.startswith(key[0]) and value > now.get(key, -1e9):
                        now[key] = value
        paths, before = now, ch
    for (text, a, b), score in paths.items():
        if text == want:
            out = max(out, score + (channel.log(a, b, toxicity.END) if a else -50.0))
    return out


def test_very_long_token(spark):
    """A token of half a million characters takes time in proportion."""
    docs = spark.createDataFrame([(1, " ".join(CLEAN))], "doc_id long, text string")
    channel = toxicity.Channel({r["gram"]: r["n"] for r in toxicity.letter_counts(docs).collect()})
    took = []
    for n in (60_000, 240_000):
        start = time.process_time()
        channel.restore("w4lk" * (n // 4))
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 1


def test_other_alphabets(spark):
    """Disguises are restored in any alphabet that documents are written in."""
    docs = spark.createDataFrame([(i, "дурак идиот погода сегодня хорошая и мы идём гулять") for i in range(4)], "doc_id long, text string")
    scorer = toxicity.Scorer({r["gram"]: r["n"] for r in toxicity.letter_counts(docs).collect()}, None, None)
    assert "дурак" in scorer.words("д.у.р.а.к".encode()) and "идиот" in scorer.words("идиооот".encode())
