"""Linking items to companies and topics by names, and pairs of hot stories to ask about."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import titles as T


def _hits(text: Column, companies: dict[str, list[str]]) -> Column:
    each = []
    for slug, aliases in companies.items():
        found = F.lit(False)
        for alias in aliases:
            found = found | T.names(text, alias)
        each.append(F.when(found, slug))
    return F.filter(F.array(*each).cast("array<string>"), lambda x: x.isNotNull())


def link_companies(items: DataFrame, text: str, companies: dict[str, list[str]]) -> DataFrame:
    """items with companies: those of whom an alias stands in the text and means them, in the order given. One pass, no join."""
    return items.withColumn("companies", _hits(F.coalesce(F.col(text), F.lit("")), companies))


def relink(items: DataFrame, text: str, ts: str, since: str, companies: dict[str, list[str]], changed: list[str]) -> DataFrame:
    """Recent items that a changed company's aliases may concern (a plain search comes first) and that now name it, with all companies."""
    low = F.lower(F.col(text))
    near = F.lit(False)
    for alias in {a.removeprefix("=") for slug in changed for a in companies[slug]}:
        near = near | low.contains(alias.lower())
    return link_companies(items.where((F.col(ts) >= F.lit(since).cast("timestamp")) & near), text, companies).where(F.arrays_overlap("companies", F.array(*[F.lit(c) for c in changed])))


def assign_topics(items: DataFrame, texts: list[str], topics: list[dict], most: int = 8) -> DataFrame:
    """item columns with topic and its evidence (words in order, then category and event), a row for each topic with any.

    topics: slug, keywords, categories, events. items has category and event_type.
    """
    text = F.concat_ws("\n", *texts)
    rows = []
    for t in topics:
        words = [F.when(T.names(text, w), w) for w in t["keywords"]]
        words.append(F.when(F.col("category").isin(*t["categories"]), F.concat(F.lit("分类:"), "category")) if t["categories"] else F.lit(None).cast("string"))
        words.append(F.when(F.col("event_type").isin(*t["events"]), F.concat(F.lit("事件:"), "event_type")) if t["events"] else F.lit(None).cast("string"))
        rows.append(F.struct(F.lit(t["slug"]).alias("topic"), F.slice(F.filter(F.array(*words), lambda x: x.isNotNull()), 1, most).alias("evidence")))
    return items.withColumn("t", F.explode(F.array(*rows))).where(F.size("t.evidence") > 0).select(*items.columns, "t.topic", "t.evidence")


def tagged(items: DataFrame, tags: DataFrame, ident: str = "item_id") -> DataFrame:
    """Items with each of their topics once."""
    return items.join(tags.select(ident, "topic").distinct(), ident)


def hot_pairs(stories: DataFrame, top: int, hours: float, most: int, judged: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Pairs a before b of the hottest stories that share a company and began within some hours, without those judged; the first ones in rank order.

    stories: story_id, heat, first_at, companies. Only the top stories are paired: their number is the feature's bound.
    """
    from pyspark.sql import Window

    best = stories.orderBy(F.col("heat").desc(), "story_id").limit(top)
    ranked = best.withColumn("r", F.row_number().over(Window.orderBy(F.col("heat").desc(), "story_id")))  # top rows
    each = ranked.select("story_id", "r", "first_at", F.explode("companies").alias("company"))
    x, y = each.alias("x"), each.alias("y")
    near = F.abs(F.unix_micros(F.col("x.first_at").cast("timestamp")) - F.unix_micros(F.col("y.first_at").cast("timestamp"))) <= int(hours * 3_600_000_000)
    pairs = x.join(y, F.col("x.company") == F.col("y.company")).where((F.col("x.r") < F.col("y.r")) & near)
    pairs = pairs.select(F.col("x.story_id").alias("a"), F.col("y.story_id").alias("b"), F.col("x.r").alias("ar"), F.col("y.r").alias("br")).distinct()
    if judged is not None:
        pairs = pairs.where(~judged(F.col("ar"), F.col("br")))
    return pairs.orderBy("ar", "br").limit(most)
