"""Stories, event matching, source times and chains against plain Python, one article after another."""

import difflib
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom import story_queries
from newsloom.functions import text as X
from newsloom.functions import times as C
from newsloom.functions import titles as T
from newsloom.operators import dedup as D
from newsloom.operators import feed as O
from newsloom.operators import stats as M
from newsloom.operators import stories as Y

SCHEMA = "id long, title string, published timestamp, source_type string, channel string, event_type string, companies array<string>, official boolean, form string, url string"


def norm(t):
    t = t.lower()
    for a, b in T.STORY_SAME.items():
        t = t.replace(a, b)
    return re.sub(r"[\W_]+", "", re.sub(r"\b(?:launches|launched|releases|released|introduces|introduced)\b", "launch", t))


def grams(t):
    return {t[i : i + 3] for i in range(max(1, len(t) - 2))}


def made(seed, n=140):
    r = random.Random(seed)
    words = "chip maker opens plant in texas new model beats rival quarter sales rise fall cloud deal robot arm test lab grid power launch fund".split()
    base = [" ".join(r.choices(words, k=r.randrange(4, 9))) for _ in range(7)]
    out = []
    for i in range(n):
        t = r.choice(base).split()
        for _ in range(r.choice([0, 1, 1, 2, 2])):
            t[r.randrange(len(t))] = r.choice(words)
        t = " ".join(t) + r.choice(["", "", " 2024", " 3.5%"])
        if r.random() < 0.1:
            t = f"Why is {r.choice(['Arm', 'Oracle'])} stock {r.choice(['sliding', 'rising'])} today?"
        at = datetime(2024, 3, 1) + timedelta(minutes=r.randrange(0, 6000))
        official = r.random() < 0.1
        out.append((i, t, at, "rss", r.choice(["ai", "stock"]), r.choice([None, "other", "launch", "earnings"]), r.choice([[], ["a"], ["a", "b"], ["b"]]), official, "8-K" if official and r.random() < 0.5 else None, f"http://x/{r.randrange(60)}"))
    return out


def guard(a, b):
    numbers = lambda x: set(re.findall(r"\d+(?:\.\d+)*", x[1]))
    move = lambda x: x[1].startswith("Why is")
    apart = abs((a[2] - b[2]).total_seconds())
    day = lambda x: (x[2] - timedelta(hours=5 if x[2] < datetime(2024, 3, 10, 7) else 4)).date()
    if apart > 72 * 3600 or move(a) and move(b) and day(a) != day(b):
        return 0.0
    shared = set(a[6]) & set(b[6])
    if a[6] and b[6] and not shared:
        return 0.0
    if not a[7] and not b[7] and len(norm(a[1])) >= 8 and norm(a[1]) == norm(b[1]) and apart <= 6 * 3600:
        return 1.0
    if a[4] != b[4] and not shared:
        return 0.0
    if a[5] not in (None, "other") and b[5] not in (None, "other") and a[5] != b[5]:
        return 0.0
    if a[7] and b[7] and a[9] != b[9] and (a[8] or b[8]):
        return 0.0
    if numbers(a) and numbers(b) and numbers(a) != numbers(b):
        return 0.0
    return None


def score(a, b):
    held = guard(a, b)
    if held is not None:
        return held
    x, y = norm(a[1]), norm(b[1])
    if min(len(x), len(y)) < 8 or len(grams(x) & grams(y)) < 0.3 * min(len(grams(x)), len(grams(y))):
        return 0.0
    return difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters(spark, seed):
    rows = made(seed)
    articles = spark.createDataFrame(rows, SCHEMA)
    order = sorted(rows, key=lambda x: (x[2], x[0]))
    want = {(b[0], a[0]): score(b, a) for k, b in enumerate(order) for a in order[:k] if score(b, a) >= Y.THRESHOLD}
    found = Y.kept(Y.links(articles))
    got = {(r.later, r.earlier): r.score for r in found.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 50
    # one article after another: the best of the anchors so far
    anchor = {}
    for k, b in enumerate(order):
        near = [(want[b[0], a[0]], -k2, a[0]) for k2, a in enumerate(order[:k]) if (b[0], a[0]) in want and anchor[a[0]] == a[0]]
        anchor[b[0]] = max(near)[2] if near else b[0]
    members = Y.kept(Y.assign(articles, found))
    assert {r.id: r.anchor for r in members.collect()} == anchor
    # merges: stories with two linked pairs and anchors that no guard keeps apart, until none is left
    by, place = {x[0]: x for x in rows}, {x[0]: k for k, x in enumerate(order)}
    now = dict(anchor)
    for _ in range(10):
        pairs = {}
        for (b, a), s in want.items():
            x, y = sorted((now[a], now[b]), key=place.get)
            if x != y:
                pairs.setdefault((x, y), []).append(s)
        fit = {k: max(v) for k, v in pairs.items() if len(v) >= 2 and guard(by[k[1]], by[k[0]]) != 0}
        late = {y for _, y in fit}
        joins = {}
        for (x, y), s in fit.items():
            if x not in late:
                joins[y] = max(joins.get(y, (-1, 0, 0)), (s, -place[x], x))
        if not joins:
            break
        now = {i: joins[s][2] if s in joins else s for i, s in now.items()}
    assert {r.id: r.anchor for r in Y.merge(articles, found, members).collect()} == now
    assert len(set(now.values())) < len(set(anchor.values())) < len(rows)


def test_no_articles(spark):
    assert Y.cluster(spark.createDataFrame([], SCHEMA)).count() == 0


def test_titles(spark):
    cases = [
        ("Why is Arm stock sliding today?", True), ("What's going on with Oracle stock Tuesday?", True), ("Why Nvidia stock jumped 30% in September", False), ("QQQ is up", True),
        ("甲骨文股价今日下跌原因分析", True), ("Chip stocks rally", False), ("Green day on Friday for Tesla", True), ("Tesla falls less than broader market", True),
    ]
    rows = spark.createDataFrame(cases, "t string, want boolean").select("*", T.stock_move(F.col("t")).alias("got")).collect()
    assert all(r.got == r.want for r in rows), [r for r in rows if r.got != r.want]
    quarters = [("Q3 2025 earnings", "2025-Q3"), ("2024 results: quarter 2", "2024-Q2"), ("2025年第三季度", "2025-Q3"), ("2025", None)]
    assert all(r.got == r.want for r in spark.createDataFrame(quarters, "t string, want string").select("*", T.quarter(F.col("t")).alias("got")).collect())
    senses = [("amd", "Wet AMD treatment", False), ("amd", "AMD chip", True), ("apple", "apple pie", False), ("apple", "Apple orchard", False), ("apple", "apple picking on the iPhone", True), ("meta", "Meta-analysis of meta", False), ("meta", "Meta model", True), ("苹果", "苹果园采摘", False)]
    for alias, text, want in senses:
        assert spark.range(1).select(T.sense(alias, F.lit(text))).first()[0] == want, text
    garbled = [("台*积电", "stray_symbol"), ("核心F核心", "echo"), ("智能(体", "unbalanced_("), ("好好好好", "repetition"), ("привет", "foreign_script"), ("a​b", "invisible_character"), ("正常 title", None), ("", None), (None, None)]
    for r in spark.createDataFrame(garbled, "t string, want string").select("*", T.problem(F.col("t")).alias("got")).collect():
        assert r.got == r.want, r


def test_normal_url(spark):
    cases = {"HTTP://u:p@A.B/x?utm_source=1&q=a%20b&token=z#f": "http://a.b/x?q=a+b", "ftp://a.b/x": "", "javascript://a": "", "https://a.b": "https://a.b/", "": "", "http://a.b/?x=&y": "http://a.b/?x=&y="}
    got = {r.u: r.n for r in spark.createDataFrame([(u,) for u in cases], "u string").select("u", X.normal_url(F.col("u")).alias("n")).collect()}
    assert got == cases


def test_source_times():
    seen = "2024-03-01T00:00:00Z"
    assert C.parse("2024-02-29T12:00:00+02:00", "iso", None, seen) == ("2024-02-29T10:00:00.000000Z", None, None, "second", "valid")
    assert C.parse("2024-02-29T12:00", "iso", "UTC", seen)[3:] == ("minute", "valid")
    assert C.parse("Thu, 29 Feb 2024 12:00:00 GMT", "feed", None, seen)[0] == "2024-02-29T12:00:00.000000Z"
    assert C.parse("1709208000000", "epoch_ms", None, seen)[0] == "2024-02-29T12:00:00.000000Z"
    assert C.parse("2024-02", "month", "America/New_York", seen)[1:3] == ("2024-02-01T05:00:00.000000Z", "2024-03-01T05:00:00.000000Z")
    assert C.parse("2024-03-10T02:30:00", "iso", "America/New_York", None)[4] == "nonexistent_local_time"
    assert C.parse("2024-11-03T01:30:00", "iso", "America/New_York", None)[4] == "ambiguous_local_time"
    assert [C.parse(x, "iso", None, seen)[4] for x in ("", None, "soon", "2024-02-29T12:00:00", "2024-03-01T00:10:01Z")] == ["missing", "missing", "invalid", "missing_timezone", "future_suspect"]
    assert C.parse("2024-03-01T00:10:00Z", "iso", None, seen)[4] == "valid" and C.parse("9" * 30, "epoch_s", None, seen)[4] == "invalid"


@pytest.mark.parametrize("n", [65, 100, 300])
def test_long_chains(spark, n):
    """Chains of any length end; cycles and missing ids are told apart."""
    rows = [(i, i - 1 if i else None) for i in range(n)] + [(1000 + i, 1000 + (i + 1) % 5) for i in range(5)] + [(2000, 1003), (3000, 3001)]
    got = {r.id: (r.end, r.state) for r in D.follow(spark.createDataFrame(rows, "id long, to long"), "id", "to").collect()}
    assert all(got[i] == (0, "ok") for i in range(n)) and all(got[i][1] == "cycle" for i in (1000, 1004, 2000)) and got[3000] == (3001, "missing")


def test_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long")
    assert {r.component for r in D.components(edges).collect()} == {0}


def test_refused_score_has_default_heat(spark):
    heat = lambda s: spark.range(1).select(O.item_heat(F.lit(s).cast("int"), F.lit("launch"), F.lit(False), F.lit(0.0))).first()[0]
    assert heat(-1) == heat(None) == 0.5 and heat(80) == 0.8


def test_fingerprint_counts_repeats(spark):
    of = lambda xs: M.fingerprint(spark.createDataFrame([(x,) for x in xs], "x int"), ["x"]).first().digest
    assert of([1, 1, 5]) != of([2, 2, 5]) and of([1, 5, 1]) == of([1, 1, 5]) and of([None]) != of([])


def test_event_match(spark):
    """Decisions by rules in order."""
    from newsloom.operators import matching

    t0 = datetime(2024, 3, 1)
    row = lambda **k: {"a_title": "Nvidia announces the new Rubin platform", "b_title": "Nvidia announces new Rubin platform", "a_type": "launch", "b_type": "launch", "a_entities": ["n"], "b_entities": ["n"], "a_time": t0, "b_time": t0, **{f"{s}_{n}": [] for s in "ab" for n in ("periods", "versions", "modalities", "facts")}, **k}
    cases = [
        (row(), "candidate_link"), (row(b_entities=["x"]), "no_match"), (row(b_type="earnings"), "no_match"), (row(b_type="other", b_title="something else entirely here"), "needs_review"),
        (row(a_title="Nvidia denies Rubin delay"), "no_match"), (row(b_time=t0 + timedelta(days=15)), "no_match"), (row(a_facts=["f"], b_facts=["f"], b_title="Other words altogether", b_time=t0 + timedelta(days=40)), "candidate_link"),
        (row(a_periods=["2024-Q1"], b_periods=["2024-Q2"]), "no_match"), (row(a_title="Llama 4.1 model", b_title="Llama 4.2 model"), "no_match"),
        (row(a_title="earnings Q1 2024 of the firm", b_title="2024 Q1 another wording", a_type="earnings", b_type="earnings"), "candidate_link"),
    ]
    schema = "i int, a_title string, b_title string, a_type string, b_type string, a_entities array<string>, b_entities array<string>, a_time timestamp, b_time timestamp, " + ", ".join(f"{s}_{n} array<string>" for s in "ab" for n in ("periods", "versions", "modalities", "facts"))
    names = [x.split()[0] for x in schema.split(", ")][1:]
    got = {r.i: r for r in matching.assess(spark.createDataFrame([(i, *[c[n] for n in names]) for i, (c, _) in enumerate(cases)], schema)).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i].decision == want, (i, got[i])
    assert got[6].score == 0.95 and got[9].score == matching.THRESHOLD


def test_reindex_of_pages(spark, sf):
    """The registered reindex against the plain rules."""
    rows = [tuple(r) for r in story_queries.articles(spark, sf).select([x.split()[0] for x in SCHEMA.split(", ")]).collect()]
    assert len(rows) == story_queries.merged_stories(spark, sf).count()


def copied(seed, n=300):
    """Rows as made(), with many copies, headlines in brackets, untitled and undated ones, null companies and equal times."""
    r = random.Random(seed)
    out = []
    for i, (_, t, at, source, channel, event, companies, official, form, url) in enumerate(made(seed, n)):
        if r.random() < 0.4:
            t = r.choice(["chip maker opens new plant", "Chip maker opens plant", "new test of a cloud", "cloud"])
        if r.random() < 0.1:
            t, source = f"【{r.choice(['Quarter sales rise again', 'cloud'])}】{t}", "sina"
        at = at.replace(minute=at.minute // 30 * 30) if r.random() < 0.95 else None
        companies = r.choice([companies, companies, [None], ["a", None], None])
        out.append((i * 7 % n, r.choice([t] * 20 + [None, ""]), at, source, r.choice([channel, channel, None]), event, companies, official, form, r.choice([url, "http://hkexnews.hk/1", None])))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_settled_without_pairs(spark, monkeypatch, seed):
    """What settle() tells of articles is what links(), assign() and merge() tell over pairs of them."""
    monkeypatch.setattr(Y, "TOGETHER", 60)
    monkeypatch.setattr(Y, "SMALL", 20)
    articles = spark.createDataFrame(copied(seed), SCHEMA)
    found = Y.kept(Y.links(articles))
    ends = [x for r in found.collect() for x in (r.later, r.earlier)]
    members = Y.kept(Y.assign(articles, found))
    anchor = {r.id: r.anchor for r in members.collect()}
    merged = {r.id: r.anchor for r in Y.merge(articles, found, members).collect()}
    got = {r.id: r for r in Y.settle(articles, ["class_id", "n_links", "anchor", "merged"]).collect()}
    assert len(got) == 300 and len(ends) > 1000 and merged != anchor
    assert {i: r.n_links for i, r in got.items()} == {i: ends.count(i) for i in got}
    assert {i: r.anchor for i, r in got.items()} == anchor
    assert {i: r.merged for i, r in got.items()} == merged
    keys = {r.id: r.key for r in Y.facts(articles).collect()}
    assert all(r.class_id == (min(j for j in keys if keys[j] == keys[i]) if len(keys[i]) >= Y.LETTERS else i) for i, r in got.items())


def test_more_than_120_titles_share_more(spark):
    """A title's like is found, whatever number of other titles have more trigrams in common with it."""
    from newsloom.functions import alike

    title = "".join(chr(97 + i % 26) + chr(97 + i * 7 % 26) for i in range(20))
    # the halves change places: nearly all trigrams are shared, but no long run stays in order
    thirds = title[:13], title[13:26], title[26:]
    others = [thirds[2] + thirds[1] + thirds[0] + f"{i:03d}" for i in range(150)]
    like = "".join(c if i % 9 else "z" for i, c in enumerate(title))
    rows = spark.createDataFrame([(t,) for t in [title, like, *others]], "key string")
    assert {(r.a, r.b) for r in Y.alike_titles(rows).collect() if title in (r.a, r.b)} == {(title, like), (like, title)}
    # long titles, and equal ones of the two methods
    long = [title * 2 + "q" * 40 + title, title * 2 + "q" * 40 + title[:-3] + "xyz", "q" * 150]
    assert {(a, b): r for a, b, r in alike.alike(long, None, 0.3, 0.72)} == {(a, b): r for a in long for b in long if a != b and (r := difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()) >= 0.72}
    assert sorted(alike.alike([title, *others[:3]], [like, long[0]], 0.3, 0.72)) == sorted(alike.alike([title, like], None, 0.3, 0.72))


def test_copies_make_no_pairs(spark):
    """4000 copies of a title, of which pairs would be 8 million."""
    at = datetime(2024, 3, 1)
    rows = [(i, "chip maker opens new plant", at + timedelta(seconds=i), "rss", "ai", None, [], False, None, "u") for i in range(4000)]
    got = Y.settle(spark.createDataFrame(rows, SCHEMA), ["class_id", "n_links", "anchor", "merged"]).distinct().collect()
    assert len(got) == 4000 and all((r.class_id, r.n_links, r.anchor, r.merged) == (0, 3999, 0, 0) for r in got)
