"""Samples, splits, intake of human labels, approvals, gates and dataset checks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import bps
from .sync import sample_per_stratum


def greedy_split(groups: DataFrame, shares: dict[str, float]) -> DataFrame:
    """group, split: whole groups, largest first, each to the split that lacks most of its share.

    groups: group, n. Groups of one size are alike but for their names, so the driver's loop goes over the sizes that occur and how often, which
    are few, and hands out ranges of ranks: it takes as many steps as there are groups at most, and no group's name leaves the executors.
    """
    spark = groups.sparkSession
    sizes = [(r["n"], r["c"]) for r in groups.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.col("n").desc()).collect()]  # a row for each size
    total = sum(n * c for n, c in sizes) or 1
    have = dict.fromkeys(shares, 0)
    names = list(shares)
    out = []
    for n, count in sizes:
        done = 0
        while done < count:
            lacks = {s: shares[s] * total - have[s] for s in names}
            best = max(names, key=lambda s: (lacks[s], -names.index(s)))
            others = [lacks[s] for s in names if s != best]
            run = count - done
            if others:
                # as many groups of this size as leave it the one that lacks most; of equals the first named does
                lead = lacks[best] - max(others)
                tied = min(names.index(s) for s in names if s != best and lacks[s] == max(others))
                run = min(run, max(1, int(lead // n) + int(lead % n != 0 or names.index(best) < tied)))
            out.append((n, done + 1, done + run, best))
            have[best] += n * run
            done += run
    ranges = spark.createDataFrame(out, "n long, low long, high long, split string")
    ranked = groups.withColumn("_r", F.row_number().over(Window.partitionBy("n").orderBy("group")))
    r = ranges.withColumnRenamed("n", "_n")
    return ranked.join(F.broadcast(r), (F.col("n") == F.col("_n")) & F.col("_r").between(F.col("low"), F.col("high"))).select("group", "n", "split")


def blind_holdout(cases: DataFrame, recent: Column, source: str, share: float, seed: str) -> DataFrame:
    """group, split: groups with a recent case or one of a source go to test; then, in order of their hashes, as many more as the share of cases wants; the rest is train.

    cases: group, source and what recent asks for.
    """
    by = cases.groupBy("group").agg(F.count("*").alias("n"), F.max(recent.cast("int")).alias("recent"), F.max((F.col("source") == source).cast("int")).alias("held"))
    fixed = (F.coalesce("recent", F.lit(0)) == 1) | (F.coalesce("held", F.lit(0)) == 1)
    total, have = by.agg(F.sum("n"), F.sum(F.when(fixed, F.col("n")).otherwise(0))).first() or (0, 0)
    want = (total or 0) * share - (have or 0)
    draw = F.sha2(F.concat(F.lit(seed + ":"), F.col("group").cast("string")), 256)
    named = by.withColumns({"fixed": fixed, "draw": draw})
    # a running sum over the first digits' buckets, then within a bucket, so that no task sorts all groups
    free = named.where(~F.col("fixed")).withColumn("bucket", F.substring("draw", 1, 3))
    before = free.groupBy("bucket").agg(F.sum("n").alias("s")).withColumn("ahead", F.sum("s").over(Window.orderBy("bucket")) - F.col("s")).drop("s")  # 4096 rows
    w = Window.partitionBy("bucket").orderBy("draw", "group").rowsBetween(Window.unboundedPreceding, -1)
    filled = free.join(F.broadcast(before), "bucket").withColumn("upto", F.col("ahead") + F.coalesce(F.sum("n").over(w), F.lit(0)))
    rest = filled.select("group", "n", F.when(F.col("upto") < want, "test").otherwise("train").alias("split"))
    return named.where("fixed").select("group", "n", F.lit("test").alias("split")).union(rest)


def sample_batch(rows: DataFrame, stratum: str, ident: str, seed: str, k: int, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """A batch's identity (one row: batch, n, cutoff) and its members; the same rows, seed, size and cutoff give the same batch."""
    members = sample_per_stratum(rows.where(F.col(ident) <= cutoff), stratum, ident, seed, k).select(ident, stratum, "rank")
    each = F.sha2(F.concat_ws(":", F.col(stratum).cast("string"), F.col("rank").cast("string"), F.col(ident).cast("string")), 256)
    digest = members.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(each, 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("d"))
    return digest.select(F.sha2(F.concat_ws(":", F.lit(seed), F.lit(k), F.lit(cutoff), F.coalesce("d", F.lit(""))), 256).alias("batch"), "n", F.lit(cutoff).alias("cutoff")), members


def kappa_bootstrap(cells: Sequence[tuple], rounds: int = 2000, seed: int = 20261007) -> tuple[float, float] | None:
    """The percentile interval of Cohen's kappa over resampled cases; None where no round has a kappa.

    cells: two labels and how many cases have them. To resample cases is to draw the counts of cells from their shares, so the work does not
    grow with the cases.
    """
    n = sum(c for *_, c in cells)
    if not n:
        return None
    names = sorted({x for a, b, _ in cells for x in (a, b)}, key=repr)
    a, b = (np.array([names.index(cell[k]) for cell in cells]) for k in (0, 1))
    drawn = np.random.default_rng(seed).multinomial(n, np.array([c for *_, c in cells]) / n, rounds)
    side = lambda at: np.stack([drawn[:, at == k].sum(axis=1) for k in range(len(names))], axis=1)
    expected = (side(a) * side(b)).sum(axis=1) / (n * n)
    observed = drawn[:, a == b].sum(axis=1) / n
    fine = expected < 1
    values = np.sort((observed[fine] - expected[fine]) / (1 - expected[fine]))
    return (float(values[int(0.025 * (len(values) - 1))]), float(values[int(0.975 * (len(values) - 1))])) if len(values) else None


def agreement_interval(doubly: DataFrame, a: str, b: str, rounds: int = 2000, seed: int = 20261007) -> DataFrame:
    """n, low, high of kappa over cases with two labels; only the counts of pairs of labels leave the executors."""
    cells = [(r[0], r[1], r["n"]) for r in doubly.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n")).orderBy(a, b).collect()]
    return doubly.sparkSession.createDataFrame([(sum(c for *_, c in cells), *(kappa_bootstrap(cells, rounds, seed) or (None, None)))], "n long, low double, high double")


def summary(df: DataFrame, actual: str, predicted: str, abstain: str) -> DataFrame:
    """One row: n, coverage (share not abstained), accuracy and macro F1 over what is covered."""
    from .stats import per_class

    all_ = df.agg(F.count("*").alias("n"), F.count_if(F.col(predicted) != abstain).alias("covered"), F.count_if(F.col(predicted) == F.col(actual)).alias("right"))
    f1 = per_class(df.where(F.col(predicted) != abstain), actual, predicted).agg(F.avg(F.coalesce("f1", F.lit(0.0))).alias("macro_f1"))
    return all_.crossJoin(f1).select("n", F.try_divide("covered", "n").alias("coverage"), F.try_divide("right", "covered").alias("accuracy"), "macro_f1")  # one row each


def compare_models(base: DataFrame, new: DataFrame, key: str, metrics: Sequence[str], tolerance: float = 0.02) -> DataFrame:
    """The difference of each metric between two models for each key, and whether it fell by more than a tolerance."""
    b = base.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("base")) for m in metrics])).alias("x")).select(key, "x.*")
    n = new.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("new")) for m in metrics])).alias("x")).select(key, "x.*")
    return b.join(n, [key, "metric"], "full").withColumn("delta", F.col("new") - F.col("base")).withColumn("regression", F.coalesce(F.col("delta") < -tolerance, F.lit(True)))


def exact_components(reviews: DataFrame, case: str, reviewer: str, components: Sequence[str]) -> DataFrame:
    """For each part of a judgement: how many doubly judged cases there are, and in how many all reviewers agree on it exactly."""
    by = reviews.groupBy(case).agg(F.count_distinct(reviewer).alias("r"), *[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(c) for c in components]).where("r > 1")
    one = by.agg(F.count("*").alias("n"), *[F.count_if(F.col(c) == 1).alias(c) for c in components])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col("n"), F.col(c).alias("same")) for c in components])).alias("x")).select("x.*").withColumn("bps", bps(F.col("same"), F.col("n")))


def intake_faults(rows: DataFrame, cases: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows of human labels with what is wrong: no case of that id, a case labelled twice by one person, other content than the case's, a label not allowed, no reviewer.

    rows: case_id, reviewer, label, content_sha256; cases: case_id, content. Rows without a fault are left out.
    """
    known = cases.select("case_id", F.sha2("content", 256).alias("_sha"))
    twice = F.count("*").over(Window.partitionBy("case_id", "reviewer"))
    wrong = F.array(
        F.when(F.col("_sha").isNull(), "unknown_case"),
        F.when(F.col("_n") > 1, "duplicate"),
        F.when(F.col("_sha") != F.col("content_sha256"), "content"),
        F.when(~F.coalesce(F.col("label").isin(*labels), F.lit(False)), "label"),
        F.when(F.coalesce(F.trim("reviewer"), F.lit("")) == "", "reviewer"),
    )
    return rows.withColumn("_n", twice).join(known, "case_id", "left").withColumn("faults", F.array_join(F.filter(wrong, lambda x: x.isNotNull()), ",")).where("faults <> ''").drop("_n", "_sha")


def approvals(reviews: DataFrame, current: DataFrame, floors: dict[str, int]) -> DataFrame:
    """Each subject's approval: that of its latest review, if what it approved is still so, and no measure lies below its floor.

    reviews: subject, sequence, decision, metrics_sha; current: subject, metrics_sha and measures. States: approved, rejected, stale,
    below, unreviewed.
    """
    last = reviews.groupBy("subject").agg(F.max_by(F.struct("decision", F.col("metrics_sha").alias("seen")), "sequence").alias("x")).select("subject", "x.*")
    low = F.lit(False)
    for name, floor in floors.items():
        low = low | ~F.coalesce(F.col(name) >= floor, F.lit(False))
    state = F.when(F.col("decision").isNull(), "unreviewed").when(F.col("decision") != "approve", "rejected").when(~F.col("seen").eqNullSafe(F.col("metrics_sha")), "stale").when(low, "below").otherwise("approved")
    return current.join(last, "subject", "left").select("subject", state.alias("state"))


def tampered(reviews: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Stored reviews whose chain does not hold: sequence numbers without gaps from 1, and a hash over the content and the hash before. reviews: sequence, sha and columns."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
    before = F.lag(F.struct("sequence", "sha")).over(Window.partitionBy("subject").orderBy("sequence"))
    linked = reviews.withColumn("_b", before)
    good = (F.col("sha") == F.sha2(F.concat(F.coalesce(F.col("_b.sha"), F.lit("")), text), 256)) & (F.col("sequence") == F.coalesce(F.col("_b.sequence"), F.lit(0)) + 1)
    return linked.where(~F.coalesce(good, F.lit(False))).drop("_b")


def verified_holdout(cases: DataFrame, cutoff: Column, source: str) -> DataFrame:
    """Cases that break a verified holdout: one after the cutoff or of the source that is not in test."""
    return cases.where(((F.col("at") >= cutoff) | (F.col("source") == source)) & (F.col("split") != "test"))


def probability_faults(predictions: DataFrame, ident: str, probabilities: str, tolerance: float = 1e-9) -> DataFrame:
    """Predictions whose probabilities cannot be: outside 0 to 1, a sum other than 1, or no single greatest."""
    p = F.col(probabilities)
    wrong = F.array(
        F.when(F.coalesce(F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1)), F.lit(True)), "range"),
        F.when(F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) > tolerance, "sum"),
        F.when(F.size(F.filter(p, lambda x: x == F.array_max(p))) > 1, "argmax"),
    )
    return predictions.select(ident, F.array_join(F.filter(wrong, lambda x: x.isNotNull()), ",").alias("faults")).where("faults <> ''")


def silver_targets(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """Cases that a model should label: all of test, of train and dev those that nobody labelled."""
    return cases.where("split = 'test'").union(cases.where("split <> 'test'").join(labels.select("case_id"), "case_id", "left_anti"))


def evidence_ids(outputs: DataFrame, key: str, payload: str) -> DataFrame:
    """Every evidence id that stands anywhere in a JSON output, once for each key."""
    found = F.regexp_extract_all(F.col(payload), F.lit(r'"evidence_id"\s*:\s*"([^"]+)"'), F.lit(1))
    lists = F.flatten(F.transform(F.regexp_extract_all(F.col(payload), F.lit(r'"evidence_ids"\s*:\s*\[([^\]]*)\]'), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit('"([^"]+)"'), F.lit(1))))
    return outputs.select(key, F.explode(F.array_distinct(F.concat(found, lists))).alias("evidence_id"))


def revision_faults(revisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Revisions (revision_id, entity_ids, fact_ids) with what is wrong: ids unsorted or repeated, facts repeated, a fact without evidence (revision_id, fact_id)."""
    facts = revisions.select("revision_id", F.explode("fact_ids").alias("fact_id")).distinct()
    bare = facts.join(evidence.select("revision_id", "fact_id"), ["revision_id", "fact_id"], "left_anti").groupBy("revision_id").agg(F.count("*").alias("_bare"))
    ids, fids = F.col("entity_ids"), F.col("fact_ids")
    wrong = F.array(F.when(F.array_sort(ids) != ids, "unsorted"), F.when(F.size(F.array_distinct(ids)) != F.size(ids), "repeated"), F.when(F.size(F.array_distinct(fids)) != F.size(fids), "facts"), F.when(F.col("_bare") > 0, "evidence"))
    return revisions.join(bare, "revision_id", "left").select("revision_id", F.array_join(F.filter(wrong, lambda x: x.isNotNull()), ",").alias("faults")).where("faults <> ''")


def topic_build(assignments: DataFrame, documents: DataFrame) -> DataFrame:
    """Each topic's accepted documents (the last assignment of a document decides) with their number, time span and the hash of the ordered members.

    assignments: topic, document, sequence, status; documents: document, published. The hash is that of the sorted members' hashes in
    256 parts, so that no task holds all members of a topic.
    """
    last = assignments.groupBy("topic", "document").agg(F.max_by("status", "sequence").alias("status"))
    members = last.where("status = 'accepted'").join(documents, "document")
    sha = F.sha2(F.col("document").cast("string"), 256)
    parts = members.withColumn("sha", sha).groupBy("topic", F.substring("sha", 1, 2).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha")), ""), 256).alias("h"), F.count("*").alias("n"), F.min("published").alias("a"), F.max("published").alias("z"))
    return parts.groupBy("topic").agg(F.sum("n").alias("documents"), F.min("a").alias("first_at"), F.max("z").alias("last_at"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: F.concat(x["part"], x["h"])), ""), 256).alias("manifest"))


def admission_metrics(events: DataFrame, evidence: DataFrame, publishers: DataFrame) -> DataFrame:
    """For each event what its admission asks: counts of evidence, direct evidence, documents, publishers and verified publishers.

    events: event_id, status, title; evidence: event_id, document, publisher, direct; publishers: publisher, verified.
    """
    known = evidence.join(publishers, "publisher", "left")
    by = known.groupBy("event_id").agg(F.count("*").alias("evidence"), F.count_if("direct").alias("direct"), F.count_distinct("document").alias("documents"), F.count_distinct("publisher").alias("publishers"), F.count_distinct(F.when(F.col("verified"), F.col("publisher"))).alias("verified"))
    return events.join(by, "event_id", "left").fillna(0, ["evidence", "direct", "documents", "publishers", "verified"])


#: What an event must be for admission, in order; the first that fails is its reason.
ADMISSION = {
    "status": "status in ('confirmed', 'reported')", "title": "length(trim(title)) >= 8", "evidence": "evidence >= 1", "direct": "direct >= 1", "documents": "documents >= 2", "publishers": "publishers >= 2", "verified": "verified >= 1",
}


def admission(metrics: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """event_id and the first rule that an event fails, null if it qualifies."""
    from .evaluation import first_failure

    return metrics.select("event_id", first_failure({n: F.expr(c) for n, c in (rules or ADMISSION).items()}).alias("failure"))


def status_metrics(assignments: DataFrame, group: str) -> DataFrame:
    """Effective statuses by group: counts, topics, and integer basis points decided and accepted."""
    decided = F.count_if(F.col("effective").isin("accepted", "rejected"))
    accepted = F.count_if(F.col("effective") == "accepted")
    return assignments.groupBy(group).agg(F.count("*").alias("n"), accepted.alias("accepted"), decided.alias("decided"), bps(decided, F.count("*")).alias("decided_bps"), bps(accepted, decided).alias("accepted_bps"))


def import_audit(stored: DataFrame, imported: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """rule, n: how many rows an import lost, made up, or changed in each column."""
    s = stored.select(key, F.struct(*columns).alias("s"))
    i = imported.select(key, F.struct(*columns).alias("i"))
    both = s.join(i, key, "full")
    rules = {"lost": F.col("i").isNull(), "made_up": F.col("s").isNull(), **{c: F.col("s").isNotNull() & F.col("i").isNotNull() & ~F.col(f"s.{c}").eqNullSafe(F.col(f"i.{c}")) for c in columns}}
    from .sync import violations

    return violations(both, rules)


def projected_events(stories: DataFrame, members: DataFrame, names: DataFrame) -> DataFrame:
    """Candidate events from stories: each live story's documents, entities and times after redirects. stories: story_id, redirect_to; members: story_id, document, company, published; names: company, entity."""
    from .dedup import follow

    ends = follow(stories, "story_id", "redirect_to").where("state = 'ok'").select(F.col("id").alias("story_id"), F.col("end").alias("event"))
    of = members.join(ends, "story_id").join(names, "company", "left")
    return of.groupBy("event").agg(F.count_distinct("document").alias("documents"), F.array_sort(F.collect_set("entity")).alias("entities"), F.min("published").alias("first_at"), F.max("published").alias("last_at"))


def news_api(items: DataFrame, companies: list[str] | None, themes: list[str] | None, scope: str | None, since: Column, as_of: Column, after: tuple | None, limit: int, least: int = 50) -> DataFrame:
    """A page of news signals as known at a time: visible items of companies or themes in (since, as_of], scores only where judged by then, with independence; newest first after a key (published, item_id).

    items: item_id, story_id, company, published_at, fetched_at, judged_at, score, tmt, official, themes.
    """
    from ..functions import titles as T
    from . import feed

    rows = feed.visible(items).where((F.col("published_at") > since) & (F.col("published_at") <= as_of) & (F.col("fetched_at") <= as_of))
    judged = F.coalesce(F.col("judged_at") <= as_of, F.lit(False))
    rows = feed.independence(rows).withColumn("score", F.when(judged & (F.col("score") >= 0), F.col("score")))
    if companies:
        rows = rows.where(F.col("company").isin(*companies))
    if themes:
        rows = rows.where(F.arrays_overlap("themes", F.array(*[F.lit(t) for t in themes])))
    if scope:
        rows = rows.where(F.exists("themes", lambda t: T.theme_scope(t) == scope))
    rows = rows.where(F.col("score").isNull() | (F.col("score") >= least))
    keys = [("published_at", True, None), ("item_id", True, None)]
    if after is None:
        return rows.orderBy(*[F.col(n).desc() for n, _, _ in keys]).limit(limit)
    return feed.after_key(rows, [(n, d, v) for (n, d, _), v in zip(keys, after, strict=True)], limit)


def reuse_or_judge(items: DataFrame, judged: DataFrame, keys: Sequence[str], clamp: tuple[int, int] = (0, 100)) -> DataFrame:
    """Items with the score of an equal judged one if there is any (reused), else of a rule (routine items: 25), else none (pending); scores are clamped."""
    first = judged.groupBy(*keys).agg(F.min_by("score", "item_id").alias("_s"))
    out = items.join(first, list(keys), "left")
    how = F.when(F.col("_s").isNotNull(), "reused").when(F.col("routine"), "rule").otherwise("pending")
    value = F.when(F.col("_s").isNotNull(), F.greatest(F.lit(clamp[0]), F.least(F.lit(clamp[1]), F.col("_s")))).when(F.col("routine"), 25)
    return out.withColumn("how", how).withColumn("judged_score", value).drop("_s")
