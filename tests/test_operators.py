"""Small cases of the operators: edges, ties, nulls, and values known by hand."""

from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.operators import dedup, feed, stats, sync, temporal


def one(df):
    return df.collect()[0]


def test_kappa_by_hand(spark):
    cells = [("a", "a", 10), ("a", "b", 5), ("b", "a", 3), ("b", "b", 82)]
    rows = spark.createDataFrame([(x, y) for x, y, n in cells for _ in range(n)], "a string, b string")
    r = one(stats.kappa(rows, "a", "b"))
    assert abs(r.observed - 0.92) < 1e-9 and abs(r.kappa - (0.92 - 0.759) / (1 - 0.759)) < 1e-9
    same = one(stats.kappa(spark.createDataFrame([("a", "a")] * 3, "a string, b string"), "a", "b"))
    assert same.kappa is None


def test_wilson_by_hand(spark):
    rows = spark.createDataFrame([(1, 1)] * 11 + [(1, 0)], "a int, b int")
    r = one(stats.accuracy(rows, "a", "b"))
    assert (round(r.accuracy, 4), round(r.low, 4), round(r.high, 4)) == (0.9167, 0.6461, 0.9851)


def test_temperature():
    t, loss = stats.temperature([(2.0, 70, 100), (-2.0, 30, 100)])
    assert abs(t - 2.0 / 0.8472978603872037) < 1e-4 and 0 < loss < 0.7


def test_basis_points(spark):
    r = one(spark.range(1).select(stats.bps(F.lit(1), F.lit(3)).alias("a"), stats.bps(F.lit(0), F.lit(0)).alias("b")))
    assert (r.a, r.b) == (3333, 10000)


def test_fingerprint_is_order_free(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, t string")
    f = lambda df: one(stats.fingerprint(df, ["i", "t"]))
    assert f(a) == f(a.orderBy(F.desc("i"))) and f(a) != f(a.withColumn("t", F.lit("x")))


def test_urls(spark):
    rows = [("HTTP://User@Example.COM/a?utm_source=x&b=1&token=q#f", "http://example.com/a?b=1"), ("https://x.org", "https://x.org/"), ("nonsense", ""), (None, None)]
    out = spark.createDataFrame(rows, "u string, want string").select("want", X.normal_url(F.col("u")).alias("u")).collect()
    assert all(r.u == r.want for r in out)


def test_words(spark):
    rows = spark.createDataFrame([("AI and SAID",), ("ai",), ("苹果公司",), ("x.ai!",)], "t string")
    t = F.col("t")
    got = [tuple(r) for r in rows.select(X.word_match(t, "AI"), X.word_match(t, "=AI"), X.word_match(t, "苹果")).collect()]
    assert got == [(True, True, False), (True, False, False), (False, False, True), (True, False, False)]


def test_pointers(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), ("e", "d"), ("x", "y"), ("y", "x"), ("s", "s")] + [(f"n{i}", f"n{i + 1}") for i in range(50)] + [("n50", None)]
    got = {r.id: (r.end, r.state) for r in dedup.follow(spark.createDataFrame(rows, "id string, to string"), "id", "to").collect()}
    assert got["c"] == ("a", "ok") and got["e"] == ("gone", "missing") and got["x"][1] == got["s"][1] == "cycle" and got["n0"] == ("n50", "ok")


def test_greedy_split():
    out = dedup.greedy_split([("a", 60), ("b", 20), ("c", 20)], {"train": 0.6, "dev": 0.2, "test": 0.2})
    assert out["a"] == "train" and {out["b"], out["c"]} == {"dev", "test"}


def test_places(spark):
    rows = spark.createDataFrame([(f"r{i * 37 % 1000}",) for i in range(1000)], "resource string")
    got = [r.resource for r in sync.place(rows, "resource").orderBy("place").collect()]
    assert got == sorted(got) and len(got) == 1000


def test_versions_and_nulls(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a"), (2, 1, None)], "k int, s int, state string")
    got = [(r.k, r.s, r.version) for r in temporal.changes_only(rows, "k", ["s"], "state").orderBy("k", "s").collect()]
    assert got == [(1, 1, 1), (1, 3, 2), (1, 5, 3), (2, 1, 1)]


def test_first_per_story_ties(spark):
    rows = spark.createDataFrame([(1, "s", "2024", True, 5), (2, "s", "2024", True, None), (3, "s", "2024", False, 99), (4, None, "2023", False, 1), (5, None, "2023", False, 1)], "item_id long, story_id string, published_at string, official boolean, score int")
    assert sorted(r.item_id for r in feed.first_per_story(rows).collect()) == [1, 4, 5]


def test_gate(spark):
    r = one(stats.gate(spark.createDataFrame([(5, None)], "n int, m int"), {"many": F.col("n") > 9, "known": F.col("m") > 0, "some": F.col("n") > 0}))
    assert r.failed == "many,known" and not r.passed
