"""Structured event matching: what keeps a proposal and a candidate apart, and how well they agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import titles as T

#: Least similarity of titles that links, longest days between reports, least score of a shared fact.
THRESHOLD, DAYS, SAME_FACT = 0.78, 14, 0.95


def assess(pairs: DataFrame) -> DataFrame:
    """pairs with decision (no_match, candidate_link, needs_review), score and reason; the first reason that holds decides.

    pairs: for each side a_ and b_: title, type, entities, time, periods, versions, modalities, facts (signatures). What titles tell
    of periods, versions and modalities is added to what is given.
    """
    with_title = lambda s, n, x: F.array_union(F.col(f"{s}_{n}"), x)
    for s in "ab":
        title = F.col(f"{s}_title")
        in_title = F.filter(F.array(T.quarter(title)), lambda x: x.isNotNull())
        pairs = pairs.withColumns({f"{s}_periods": with_title(s, "periods", in_title), f"{s}_versions": with_title(s, "versions", T.versions(title)), f"{s}_modalities": with_title(s, "modalities", T.modalities(title)), f"{s}_norm": T.event_title(title)})
    apart = lambda n: (F.size(f"a_{n}") > 0) & (F.size(f"b_{n}") > 0) & ~F.arrays_overlap(f"a_{n}", f"b_{n}")
    positive = F.array(*[F.lit(x) for x in ("announced", "asserted", "planned")])
    denies = lambda x, y: F.array_contains(f"{x}_modalities", "denied") & F.arrays_overlap(F.col(f"{y}_modalities"), positive)
    types = (F.col("a_type") != "other") & (F.col("b_type") != "other") & (F.col("a_type") != F.col("b_type"))
    negative = (
        F.when(apart("entities"), "primary entities are disjoint")
        .when(types, "event types conflict")
        .when(apart("periods"), "reporting periods conflict")
        .when(apart("versions"), "product or model versions conflict")
        .when(denies("a", "b") | denies("b", "a"), "denial and announcement are separate event facts")
    )
    short = F.least(F.length("a_norm"), F.length("b_norm")) < 8
    title = F.when(short, 0.0).otherwise(F.round(X.ratio()("a_norm", "b_norm"), 6))
    days = F.abs(F.unix_micros(F.col("a_time").cast("timestamp")) - F.unix_micros(F.col("b_time").cast("timestamp"))) / 86_400_000_000
    told = pairs.withColumns({"title_score": title, "negative": negative, "days": days})
    entities, fact, period = (F.coalesce(F.arrays_overlap(f"a_{n}", f"b_{n}"), F.lit(False)) for n in ("entities", "facts", "periods"))
    score = F.col("title_score")
    cases = [
        (F.col("negative").isNotNull(), "no_match", F.lit(0.0), F.col("negative")),
        (fact & (entities | (F.size("a_entities") == 0)), "candidate_link", F.greatest(F.lit(SAME_FACT), score), F.lit("same structured fact is reported by another document")),
        (F.col("days") > DAYS, "no_match", F.lit(0.0), F.lit("event times exceed the candidate window")),
        (entities & (score >= THRESHOLD), "candidate_link", score, F.lit("entity-compatible titles pass the conservative candidate threshold")),
        (entities & period & (F.col("a_type") == F.col("b_type")), "candidate_link", F.greatest(score, F.lit(THRESHOLD)), F.lit("same entity, event type, and reporting period")),
        (F.lit(True), "needs_review", F.round(score * F.when(entities, 1.0).otherwise(0.5), 6), F.lit("no hard conflict, but evidence is insufficient for an automatic candidate link")),
    ]
    out = {"decision": None, "score": None, "reason": None}
    for held, decision, value, reason in cases:
        held = F.coalesce(held, F.lit(False))
        for name, x in (("decision", F.lit(decision)), ("score", value), ("reason", reason)):
            out[name] = F.when(held, x) if out[name] is None else out[name].when(held, x)
    return told.withColumns(out).drop("negative", "days")
