"""Composite plans over the operators: story detail, source health, structured reports, self-checks, event admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import dedup, feed, temporal


def story_detail(items: DataFrame, stories: DataFrame) -> DataFrame:
    """Each live story with its members after redirects: publishers, official and total items, first and last time."""
    ends = dedup.follow(stories.select("story_id", "redirect_to"), "story_id", "redirect_to").where("state = 'ok'").select(F.col("id").alias("story_id"), F.col("end").alias("root"))
    members = feed.visible(items).join(ends, "story_id")
    return members.groupBy(F.col("root").alias("story_id")).agg(
        F.count("*").alias("items"),
        F.count_if("official").alias("official"),
        F.count_distinct("publisher").alias("publishers"),
        F.min("published_at").alias("first_at"),
        F.max("published_at").alias("last_at"),
    )


def source_status(log: DataFrame, now: str, silence_hours: float = 24.0) -> DataFrame:
    """A status for each source from its last runs, first match first: never, bad, stale, partial, ok.

    log: source_id, ran_at, ok.
    """
    runs = log.groupBy("source_id").agg(
        F.count("*").alias("runs"),
        F.count_if("ok").alias("good"),
        F.max(F.when(F.col("ok"), F.col("ran_at"))).alias("last_ok"),
        F.max_by("ok", "ran_at").alias("last"),
    )
    age = (F.unix_seconds(F.to_timestamp(F.lit(now))) - temporal.seconds("last_ok")) / 3600.0
    status = F.when(F.col("good") == 0, "never").when(~F.col("last") & (age > silence_hours), "bad").when(age > silence_hours, "stale").when(F.col("good") < F.col("runs"), "partial").otherwise("ok")
    return runs.select("source_id", "runs", "good", status.alias("status"))


def structured_report(items: DataFrame, cap: int) -> DataFrame:
    """The best items of each channel up to a cap, with citation numbers over the whole report."""
    best = feed.top_per_group(feed.visible(items), "channel", [F.coalesce("score", F.lit(50)).desc(), F.col("item_id").desc()], cap)
    return best.withColumn("citation", F.row_number().over(Window.orderBy("channel", "rank")))  # at most cap rows for each channel


def self_check(items: DataFrame, share: float = 0.5, unscored: float = 0.3) -> DataFrame:
    """check, value, ok: the largest source's share, the share without a score, and whether there is anything at all."""
    by = items.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("score").isNull()).alias("open"))
    total = by.agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.sum("open").alias("open"))
    rows = [
        F.struct(F.lit("source_share").alias("check"), F.try_divide("top", "n").alias("value"), F.coalesce(F.try_divide("top", "n") <= share, F.lit(False)).alias("ok")),
        F.struct(F.lit("unscored").alias("check"), F.try_divide("open", "n").alias("value"), F.coalesce(F.try_divide("open", "n") <= unscored, F.lit(False)).alias("ok")),
        F.struct(F.lit("any").alias("check"), F.coalesce("n", F.lit(0)).cast("double").alias("value"), (F.coalesce("n", F.lit(0)) > 0).alias("ok")),
    ]
    return total.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def news_signals(items: DataFrame, since: str, as_of: str, limit: int) -> DataFrame:
    """Visible items in (since, as_of], with independence and scores as known then, newest first."""
    window = feed.visible(items).where((F.col("published_at") > F.lit(since)) & (F.col("published_at") <= F.lit(as_of)))
    labelled = feed.independence(window)
    masked = labelled.withColumn("score", F.when(F.col("score") >= 0, F.col("score")))
    return masked.orderBy(F.col("published_at").desc(), F.col("item_id").desc()).limit(limit)
