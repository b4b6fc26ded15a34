"""Feeds: visibility, selection, one item for each story, ranking, paging, heat and mood."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Half-life of heat in hours, and what an official item gains.
HALF_LIFE, OFFICIAL_GAIN = 18.0, 1.25


def visible(items: DataFrame) -> DataFrame:
    """Items not marked as off topic; an unjudged item (null) is visible."""
    return items.where("coalesce(tmt, 1) <> 0")


def with_flag(items: DataFrame, keys: DataFrame, on: str, flag: str) -> DataFrame:
    """items with a boolean: whether their key occurs in keys. Keys are made distinct first, so rows never multiply."""
    return items.join(keys.select(on).distinct().withColumn(flag, F.lit(True)), on, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def selected(items: DataFrame, stories: DataFrame, high: int = 70, low: int = 30, sources: int = 2) -> DataFrame:
    """The selected feed: high scores, official items that are not routine, and middling ones whose live story has several sources."""
    several = stories.where((F.col("source_count") >= sources) & F.col("redirect_to").isNull())
    flagged = with_flag(items, several, "story_id", "several")
    score = F.coalesce("score", F.lit(low))
    keep = F.coalesce(F.col("score") >= high, F.lit(False)) | (F.col("official") & ~F.col("routine")) | ((score >= low) & F.col("several"))
    return flagged.where(keep).drop("several")


def first_per_story(items: DataFrame) -> DataFrame:
    """The newest item of each story, then official, then best scored, then last; an item without a story is its own."""
    w = Window.partitionBy(F.coalesce(F.col("story_id"), F.concat(F.lit("item:"), F.col("item_id").cast("string")))).orderBy(
        F.col("published_at").desc(), F.col("official").desc(), F.coalesce("score", F.lit(-1)).desc(), F.col("item_id").desc()
    )
    return items.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page with one row more than its limit, which tells whether another follows."""
    return df.orderBy(*order).offset(offset).limit(limit + 1)


def after_key(df: DataFrame, keys: Sequence[tuple[str, bool, object]], limit: int) -> DataFrame:
    """The rows that follow a key in an order of (column, descending, value); a filter and a bounded sort, never an offset."""
    cond = F.lit(False)
    equal = F.lit(True)
    for name, down, value in keys:
        c = F.col(name)
        cond = cond | (equal & ((c < F.lit(value)) if down else (c > F.lit(value))))
        equal = equal & (c == F.lit(value))
    return df.where(cond).orderBy(*[F.col(n).desc() if down else F.col(n).asc() for n, down, _ in keys]).limit(limit)


def top_per_group(df: DataFrame, group: str, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= k)


def floor_then_fill(df: DataFrame, group: str, order: Sequence[Column], floor: int, total: int) -> DataFrame:
    """A floor for each group first, then the best of the rest up to a total.

    The floors are a window that Spark cuts early. The rest comes from a bounded sort of as many rows as the total and all floors
    hold together, so no task sorts all rows; order must tell all rows apart.
    """
    w = Window.partitionBy(group).orderBy(*order)
    reserved = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= floor)
    groups = df.select(group).distinct().count()
    best = df.orderBy(*order).limit(total + floor * groups)
    rest = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") > floor).orderBy(*order).limit(total)
    both = reserved.withColumn("reserved", F.lit(1)).union(rest.withColumn("reserved", F.lit(0)))
    return both.orderBy(F.col("reserved").desc(), *order).limit(total)


def hot(stories: DataFrame, limit: int) -> DataFrame:
    """Stories with several sources first, then by heat."""
    return stories.orderBy((F.col("source_count") >= 2).desc(), F.col("heat").desc(), "story_id").limit(limit)


def item_heat(score: Column, event_type: Column, official: Column, age_hours: Column) -> Column:
    """A hundredth of the score (or a default by type where there is none or it was refused), the official gain, and exponential decay with age."""
    base = F.coalesce(F.when(score >= 0, score / 100.0), F.when(event_type.isin("insider", "other"), 0.35).otherwise(0.5))
    return base * F.when(official, OFFICIAL_GAIN).otherwise(1.0) * decay(age_hours)


def decay(age_hours: Column) -> Column:
    """Half after each half-life; an unknown time counts as one half-life, a future one as now."""
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(age_hours, F.lit(0.0)) / HALF_LIFE), F.lit(0.5))


def story_stats(items: DataFrame) -> DataFrame:
    """Each story's heat (its hottest item, raised by up to five more publishers), counts, times, companies and representative."""
    best = F.struct("official", F.coalesce("score", F.lit(-1)).alias("score"), "published_at", "item_id")
    publishers = F.count_distinct("publisher")
    return items.groupBy("story_id").agg(
        (F.max("heat") * (1 + 0.2 * F.least(F.greatest(publishers - 1, F.lit(0)), F.lit(5)))).alias("heat"),
        publishers.alias("source_count"),
        F.count("*").alias("item_count"),
        F.min("published_at").alias("first_at"),
        F.max("published_at").alias("last_at"),
        F.max(best)["item_id"].alias("item_id"),
    )


def mood(items: DataFrame, group: str, least: int = 20) -> DataFrame:
    """Mean mood weighted by score, a level, counts, and the best and worst item; no mean below a number of items."""
    known = items.where(F.col("mood").isNotNull())
    weight = F.greatest(F.coalesce("score", F.lit(1)), F.lit(1))
    mean = F.when(F.count("*") >= least, F.sum(weight * F.col("mood")) / F.sum(weight))
    key = lambda sign: F.max(F.when(F.col("mood") * sign > 0, F.struct(F.abs("mood").alias("a"), F.coalesce("score", F.lit(-1)).alias("s"), F.col("item_id"))))["item_id"]
    out = known.groupBy(group).agg(mean.alias("mean"), F.count("*").alias("n"), F.count_if(F.col("mood") > 0).alias("up"), F.count_if(F.col("mood") < 0).alias("down"), key(1).alias("best"), key(-1).alias("worst"))
    level = F.when(F.col("mean").isNull(), "unknown").when(F.col("mean") >= 0.5, "up").when(F.col("mean") <= -0.5, "down").otherwise("flat")
    return out.withColumn("level", level)


def independence(items: DataFrame) -> DataFrame:
    """Whether an item is official, its story's first report, or a repost."""
    first = F.min("item_id").over(Window.partitionBy("story_id"))
    label = F.when(F.col("official"), "official").when(F.col("story_id").isNull() | (F.col("item_id") == first), "report").otherwise("repost")
    return items.withColumn("independence", label)


def interleave(items: DataFrame, key: str, oldest: int, newest: int) -> DataFrame:
    """A quarter from the oldest and the rest from the newest rows, each once."""
    old = items.orderBy(F.col(key).asc()).limit(oldest)
    new = items.orderBy(F.col(key).desc()).limit(newest)
    return old.union(new).dropDuplicates([key])


def capped_count(df: DataFrame, cap: int) -> DataFrame:
    """The number of rows, counted up to a cap."""
    return df.select(F.lit(1).alias("one")).limit(cap).agg(F.count("*").alias("n"))
