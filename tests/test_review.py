"""Samples, splits, leases, cursors and catalogues against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import catalog as K
from newsloom.operators import evaluation as E
from newsloom.operators import review as V
from newsloom.operators import state as A
from newsloom.operators import stats as M


def greedy(groups, shares):
    total, have, out = sum(n for _, n in groups), dict.fromkeys(shares, 0), {}
    names = list(shares)
    for g, n in sorted(groups, key=lambda x: (-x[1], x[0])):
        best = max(names, key=lambda s: (shares[s] * total - have[s], -names.index(s)))
        out[g] = best
        have[best] += n
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_split(spark, seed):
    r = random.Random(seed)
    groups = [(i, r.choice([1, 2, 2, 5, 40])) for i in range(r.choice([3, 60, 200]))]
    for shares in ({"train": 0.6, "dev": 0.2, "test": 0.2}, {"a": 0.5, "b": 0.5}, {"all": 1.0}):
        got = {x.group: x.split for x in V.greedy_split(spark.createDataFrame(groups, "group long, n long"), shares).collect()}
        assert got == greedy(groups, shares)
    assert V.greedy_split(spark.createDataFrame([], "group long, n long"), {"a": 1.0}).count() == 0 if seed == 0 else True


def test_kappa_interval(spark):
    """The interval holds the kappa of the cases and narrows with their number; it is the same each time."""
    few = [("a", "a", 40), ("a", "b", 10), ("b", "a", 10), ("b", "b", 40)]
    low, high = V.kappa_bootstrap(few)
    wide = high - low
    assert low < 0.6 < high and V.kappa_bootstrap(few) == (low, high)
    low, high = V.kappa_bootstrap([(a, b, 100 * n) for a, b, n in few])
    assert low < 0.6 < high and high - low < wide / 5
    assert V.kappa_bootstrap([("a", "a", 5)]) is None and V.kappa_bootstrap([]) is None
    # case by case
    rng, cases, values = random.Random(1), [(a, b) for a, b, n in few for _ in range(n)], []
    for _ in range(800):
        drawn = rng.choices(cases, k=100)
        left, right = [x for x, _ in drawn], [y for _, y in drawn]
        expected = sum(left.count(x) * right.count(x) for x in "ab") / 10_000
        values.append((sum(x == y for x, y in drawn) / 100 - expected) / (1 - expected))
    values.sort()
    assert abs(values[20] - V.kappa_bootstrap(few)[0]) < 0.06


def test_temperature():
    """The temperature that made the labels is found again."""
    rng = random.Random(2)
    counts = {}
    for _ in range(20_000):
        z = rng.choice([-3.0, -1.0, 0.5, 2.0, 4.0])
        right = rng.random() < 1 / (1 + 2.718281828 ** (-z / 2.5))
        a, n = counts.get(z, (0, 0))
        counts[z] = (a + right, n + 1)
    t, loss = M.temperature([(z, a, n) for z, (a, n) in counts.items()])
    assert abs(t - 2.5) < 0.2 and 0 < loss < 1


def test_job_log(spark):
    log = [("a", 1, "enqueue", 0), ("a", 2, "claim", 10), ("b", 1, "enqueue", 0), ("b", 2, "claim", 0), ("b", 3, "fail", 5), ("c", 1, "claim", 95), ("c", 2, "renew", 99), ("d", 1, "claim", 0), ("d", 2, "done", 1), ("d", 3, "claim", 2), ("e", 1, "enqueue", 3)]
    log += [("f", i, "claim" if i % 2 else "fail", i) for i in range(1, 11)]
    got = {r.job: (r.state, r.claims, r.due) for r in A.job_states(spark.createDataFrame(log, "job string, seq long, kind string, at long"), F.lit(100), 50).collect()}
    assert got == {"a": ("retry", 1, 120), "b": ("retry", 1, 65), "c": ("leased", 1, None), "d": ("done", 1, None), "e": ("queued", 0, None), "f": ("dead", 5, None)}


def test_cursor():
    c = A.Cursor(b"secret")
    text = c.encode(["2024-01-01", 5], "e1", {"kind": "x"}, 100)
    assert c.decode(text, "e1", {"kind": "x"}, 99) == ["2024-01-01", 5]
    for change, fault in (({"epoch": "e2"}, "epoch"), ({"filters": {}}, "filters"), ({"now": 100}, "expired"), ({"text": "A" + text[1:] if text[0] != "A" else "B" + text[1:]}, "signature"), ({"text": "*"}, "signature")):
        with pytest.raises(ValueError, match=fault):
            c.decode(**{"text": text, "epoch": "e1", "filters": {"kind": "x"}, "now": 99, **change})
    with pytest.raises(ValueError, match="signature"):
        A.Cursor(b"other").decode(text, "e1", {"kind": "x"}, 99)


def test_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    assert K.append_versions(none("k long, version int, sha string"), none("k long, v int"), "k", ["v"]).count() == 0
    assert V.blind_holdout(none("group long, source string, at int"), F.col("at") > 1, "s", 0.5, "x").count() == 0
    assert A.job_states(none("job string, seq long, kind string, at long"), F.lit(1), 1).count() == 0
    assert V.intake_faults(none("case_id long, reviewer string, label string, content_sha256 string"), none("case_id long, content string"), ["x"]).count() == 0


def test_adjudication(spark):
    rows = [(["a", "b"], [1, 2], "c", 3), (["a"], [1], "c", 3), (["a", "b"], [1, 2], "b", 3), (["a", "b"], [1, 9], "c", 3)]
    got = [r.faults for r in E.adjudication_faults(spark.createDataFrame(rows, "reviewers array<string>, times array<int>, decider string, decided_at int")).collect()]
    assert got == ["", "two_reviews", "third_person", "after_reviews"]
