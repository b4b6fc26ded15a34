"""Tables: reading them, and the engine's views of items, stories and changes over the driver's tables.

Each view is a list of SQL expressions that mean the same in Spark and in the SQL of the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Items: one for each event; stories, sources, scores and marks follow from the ids.
ITEMS = {
    "item_id": "event_id",
    "source_id": "user_id % 20",
    "publisher": "concat('p', CAST(user_id % 7 AS STRING))",
    "story_id": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('s', CAST(user_id AS STRING)) END",
    "channel": "CASE event_id % 3 WHEN 0 THEN 'ai' WHEN 1 THEN 'robot' ELSE 'stock' END",
    "event_type": "event_type",
    "score": "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 40 WHEN 2 THEN 70 WHEN 3 THEN 90 WHEN 4 THEN -1 ELSE 25 END",
    "tmt": "CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 1 END",
    "official": "event_id % 4 = 0",
    "routine": "event_id % 8 = 0",
    "mood": "CASE event_type WHEN 'error' THEN -2 WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE NULL END",
    "company": "concat('c', CAST(event_id % 11 AS STRING))",
    "published_at": "date_trunc('minute', ts)",
    "value": "value",
}
#: Stories: what their items say; every ninth user's story redirects to the story before.
STORIES = "SELECT story_id, count(DISTINCT publisher) AS source_count, count(*) AS item_count, max(coalesce(score, 50)) AS heat, CASE WHEN min(user_id) % 9 = 0 AND min(user_id) > 0 THEN concat('s', CAST(min(user_id) - 1 AS STRING)) ELSE NULL END AS redirect_to FROM items WHERE story_id IS NOT NULL GROUP BY story_id"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in ITEMS.items()], "user_id")


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = items(spark, sf_dir).where("story_id is not null")
    out = live.groupBy("story_id").agg(F.count_distinct("publisher").alias("source_count"), F.count("*").alias("item_count"), F.max(F.coalesce("score", F.lit(50))).alias("heat"), F.min("user_id").alias("u"))
    back = F.when((F.col("u") % 9 == 0) & (F.col("u") > 0), F.concat(F.lit("s"), (F.col("u") - 1).cast("string")))
    return out.withColumn("redirect_to", back).drop("u")


def oracle_items() -> str:
    """The items view as a common table expression of the oracles' SQL."""
    return "items AS (SELECT " + ", ".join(f"{e.replace(' AS STRING)', ' AS VARCHAR)')} AS {n}" for n, e in ITEMS.items()) + ", user_id FROM events)"


def oracle_stories() -> str:
    return "stories AS (" + STORIES.replace(" AS STRING)", " AS VARCHAR)") + ")"


def with_views(sql: str) -> str:
    """A statement over items and stories, with both defined."""
    return f"WITH {oracle_items()}, {oracle_stories()} {sql}" if not sql.lstrip().startswith(",") else f"WITH {oracle_items()}, {oracle_stories()}{sql}"


def read_any(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """A table of a known kind: parquet, orc, json (lines), csv with a header, text. JSON and CSV want a schema and fail on rows that break it."""
    reader = spark.read
    if kind in ("json", "csv"):
        if schema is None:
            raise ValueError("json and csv are read by a schema, not by guessing")
        reader = reader.schema(schema).option("mode", "FAILFAST")
    if kind == "csv":
        reader = reader.option("header", True)
    return reader.format(kind).load(path)


def write_by_hash(df: DataFrame, path: str, payload: str = "payload") -> None:
    """A content-addressed sink: each payload once, in a folder by the first two digits of its hash."""
    hashed = df.select(F.sha2(F.col(payload).cast("binary"), 256).alias("sha256"), F.col(payload).alias("payload"))
    hashed.dropDuplicates(["sha256"]).withColumn("shard", F.substring("sha256", 1, 2)).write.partitionBy("shard").parquet(path)
