"""Reviews and evidence: effective decisions, agreement of reviewers, adjudication, evidence spans, event matching and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effective(assignments: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Each assignment's status: that of its latest review, else its own."""
    last = reviews.groupBy(key).agg(F.max_by("decision", "sequence").alias("decision"), F.max("sequence").alias("sequence"))
    return assignments.join(last, key, "left").withColumn("effective", F.coalesce("decision", "status"))


def reviewer_pairs(reviews: DataFrame, case: str, reviewer: str, decision: str) -> DataFrame:
    """Agreement of each two reviewers on the cases that both judged, from one row for each case and pair."""
    a = reviews.select(case, F.col(reviewer).alias("a"), F.col(decision).alias("x"))
    b = reviews.select(case, F.col(reviewer).alias("b"), F.col(decision).alias("y"))
    both = a.join(b, case).where("a < b")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("same"))


def adjudication_faults(decisions: DataFrame) -> DataFrame:
    """decisions (reviewers array, times array, decider, decided_at) with what is wrong with them, empty if sound."""
    wrong = F.array(
        F.when(F.size("reviewers") < 2, "two_reviews"),
        F.when(F.array_contains("reviewers", F.col("decider")), "third_person"),
        F.when(F.array_max("times") > F.col("decided_at"), "after_reviews"),
    )
    return decisions.withColumn("faults", F.array_join(F.filter(wrong, lambda x: x.isNotNull()), ","))


def quoted(text: Column, quote: Column, start: Column, stop: Column, sha256: Column | None = None) -> Column:
    """Whether a quote is what stands at its offsets (code points, end exclusive), and has its hash if one is given."""
    ok = (start >= 0) & (stop > start) & (F.substring(text, start + 1, stop - start) == quote)
    return F.coalesce(ok & (F.sha2(quote, 256) == sha256) if sha256 is not None else ok, F.lit(False))


def first_failure(rules: dict[str, Column]) -> Column:
    """The name of the first rule that does not hold, null if all do; a null does not hold."""
    out = None
    for name, c in rules.items():
        broken = ~F.coalesce(c, F.lit(False))
        out = F.when(broken, name) if out is None else out.when(broken, name)
    return out


def split_faults(evidence: DataFrame, assigned: DataFrame, replacements: DataFrame) -> DataFrame:
    """Evidence of an event that no replacement takes, and replacements without evidence."""
    lost = evidence.select("evidence_id").join(assigned.select("evidence_id"), "evidence_id", "left_anti").select(F.lit("unassigned").alias("fault"), F.col("evidence_id").alias("id"))
    empty = replacements.select("event_id").join(assigned.select("event_id"), "event_id", "left_anti").select(F.lit("unused").alias("fault"), F.col("event_id").alias("id"))
    return lost.union(empty)


def amendments(filings: DataFrame) -> DataFrame:
    """Each amendment's target: linked if exactly one original has its key, ambiguous if several, unresolved if none."""
    originals = filings.where("not amendment").groupBy("company", "form", "period").agg(F.count("*").alias("n"), F.min("filing_id").alias("target"))
    found = filings.where("amendment").join(originals, ["company", "form", "period"], "left")
    state = F.when(F.col("n") == 1, "linked").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return found.select("filing_id", state.alias("state"), F.when(F.col("n") == 1, F.col("target")).alias("target"))


def tier_plan(listings: DataFrame, top: int, least: float, requests: DataFrame) -> DataFrame:
    """Companies to cover with their reasons: the largest, those large enough with an industry, and those asked for; one row for each company."""
    largest = listings.groupBy("company").agg(F.max_by("ticker", F.struct("cap", "ticker")).alias("ticker"), F.max("cap").alias("cap"), F.max("industry").alias("industry"))
    first = largest.orderBy(F.col("cap").desc(), "company").limit(top).select("company", F.lit("top").alias("reason"))
    wide = largest.where((F.col("cap") >= least) & F.col("industry").isNotNull()).select("company", F.lit("tier").alias("reason"))
    asked = requests.join(largest.select("company"), "company", "left_semi").select("company", F.lit("request").alias("reason"))
    reasons = first.union(wide).union(asked).groupBy("company").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    return reasons.join(largest, "company")


def outlook(sizes: DataFrame, day: str, used: str, free: str, reserve: int) -> DataFrame:
    """Days until the disk is full: headroom over the faster of the median daily growth and the recent slope of free space."""
    w = Window.orderBy(day)  # one row for each day
    steps = sizes.withColumn("step", F.greatest(F.col(used) - F.lag(used).over(w), F.lit(0))).withColumn("age", F.row_number().over(Window.orderBy(F.col(day).desc())))
    agg = steps.agg(
        F.sort_array(F.collect_list("step")).alias("steps"),
        F.max_by(free, day).alias("now"),
        F.max_by(F.when(F.col("age") <= 8, F.col(free)), -F.when(F.col("age") <= 8, F.unix_date(day))).alias("then"),
        F.least(F.count("*"), F.lit(8)).alias("n"),
    )
    median = F.coalesce(F.get("steps", F.floor(F.size("steps") / 2).cast("int")), F.lit(0))
    slope = F.when(F.col("n") > 1, F.greatest((F.col("then") - F.col("now")) / (F.col("n") - 1), F.lit(0.0))).otherwise(0.0)
    pace = F.greatest(median, slope)
    return agg.select(median.alias("median"), slope.alias("slope"), F.when(pace > 0, F.floor(F.greatest(F.col("now") - reserve, F.lit(0)) / pace)).alias("days_left"))
