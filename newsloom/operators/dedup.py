"""Exact and near duplicates of items, sets, groups, splits and pointer chains."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import seconds


def merge_by(df: DataFrame, key: Column, ident: str, ts: str, tags: str) -> DataFrame:
    """One row for each key: the first id, first and last time, the union of tags, and how many rows."""
    return df.groupBy(key.alias("key")).agg(F.min(ident).alias("id"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.array_sort(F.collect_set(tags)).alias("tags"), F.count("*").alias("n"))


def repeats(df: DataFrame, keys: list[str], ident: str, ts: str, days: float) -> DataFrame:
    """Rows whose key was seen before within some days, with the earliest such row's id.

    The earliest row within a range of time before the row is a range frame over the key, so no pairs are made.
    """
    t = seconds(ts)
    w = Window.partitionBy(*keys).orderBy(F.col("_t")).rangeBetween(-int(days * 86_400), 0)
    first = F.min(F.struct("_t", ident)).over(w)
    return df.withColumn("_t", F.floor(t).cast("bigint")).withColumn("first_id", first[ident]).where(F.col("first_id") != F.col(ident)).drop("_t")


def donors(df: DataFrame, keys: list[str], ident: str, ts: str, judged: Column, hours: float) -> DataFrame:
    """Unjudged rows and the earliest judged row of the same key within some hours on either side."""
    span = int(hours * 3600)
    w = Window.partitionBy(*keys).orderBy("_t").rangeBetween(-span, span)
    d = F.min(F.when(judged, F.struct("_t", ident))).over(w)[ident]
    return df.withColumn("_t", F.floor(seconds(ts)).cast("bigint")).withColumn("donor", d).where(~judged & F.col("donor").isNotNull()).drop("_t")


def kept(df: DataFrame) -> DataFrame:
    """A frame that later steps read again: written to spark.checkpoint.dir where the session names one, so that no lost executor sends the work back; else cached."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        return df.cache()
    path = f"{folder.rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node it is connected with; edges: a, b. Smallest labels spread and pointers halve until nothing changes."""
    link = kept(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))).distinct())
    now = kept(link.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")))
    while True:
        top = now.join(now.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", "up", "top")
        near = link.join(top.select(F.col("node").alias("b"), "top"), "b").groupBy(F.col("a").alias("node")).agg(F.min("top").alias("best"))
        seen = top.join(near, "node")
        told = seen.select("node", F.least("up", "top", "best").alias("up"), F.col("up").alias("old")).union(seen.select(F.col("up"), F.col("best"), F.lit(None).cast(edges.schema["a"].dataType)))
        now = kept(told.groupBy("node").agg(F.min("up").alias("up"), F.max("old").alias("old")))
        if not now.where("up <> old").limit(1).count():
            return now.select("node", F.col("up").alias("component"))


def fold_groups(items: DataFrame, order: list[Column], ident: str, group: str) -> DataFrame:
    """The best row of each group, with how many others it stands for; the count aggregates before the shuffle and the rank is cut early."""
    best = items.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("rank = 1").drop("rank")
    sizes = items.groupBy(F.col(group).alias("_group")).agg((F.count("*") - 1).alias("others"))
    return best.join(sizes, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def leaks(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that lie in more than one split."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("n")).where("splits > 1")


def hash_split(df: DataFrame, ident: Column, seed: str, shares: dict[str, int]) -> DataFrame:
    """A split for each row from a hash of seed and id, by percents that add up to 100."""
    draw = (F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), ident), 256), 1, 8), 16, 10).cast("bigint") % 100).cast("int")
    out, upto = None, 0
    for name, share in shares.items():
        upto += share
        out = F.when(draw < upto, name) if out is None else out.when(draw < upto, name)
    return df.withColumn("split", out)


def greedy_split(sizes: list[tuple[str, int]], shares: dict[str, float]) -> dict[str, str]:
    """Groups, largest first, to the split that lacks most; a driver's loop over group sizes only."""
    total = sum(n for _, n in sizes) or 1
    have = dict.fromkeys(shares, 0)
    out = {}
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        best = max(shares, key=lambda s: (shares[s] * total - have[s], s))
        out[name] = best
        have[best] += n
    return out


def follow(pointers: DataFrame, ident: str, target: str) -> DataFrame:
    """Each id's last target by pointer doubling, and whether it ends in a cycle or a missing id.

    pointers: id, target (null: none). After k rounds every pointer spans 2**k steps, so chains of any length end; when a round
    settles no more ids, those left run in cycles.
    """
    rows = pointers.select(F.col(ident).alias("id"), F.col(target).alias("to"))
    ids = rows.select(F.col("id").alias("to"), F.lit(True).alias("there"))
    now = kept(rows.join(ids, "to", "left").select("id", F.when(F.col("to").isNull(), F.col("id")).otherwise(F.col("to")).alias("at"), (F.col("to").isNotNull() & F.col("there").isNull()).alias("missing"), F.col("to").isNull().alias("ended")))
    left = now.where("not missing and not ended").count()
    while left:
        nxt = now.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("ended").alias("e"), F.col("missing").alias("m"))
        now = kept(now.join(nxt, "at", "left").select("id", F.coalesce("next", "at").alias("at"), (F.col("missing") | F.coalesce("m", F.lit(False))).alias("missing"), (F.col("ended") | F.coalesce("e", F.lit(False))).alias("ended")))
        before, left = left, now.where("not missing and not ended").count()
        if left == before:
            break
    return now.select("id", F.when(F.col("ended") | F.col("missing"), F.col("at")).alias("end"), F.when(F.col("missing"), "missing").when(~F.col("ended"), "cycle").otherwise("ok").alias("state"))


def shared_grams(df: DataFrame, ident: str, grams: Column, k: int | None, least: int = 2, common: int | None = None) -> DataFrame:
    """For each row its k partners of smaller id with most grams in common, at least some; all of them if k is None. An inverted-index join.

    `common` leaves out grams that more rows than that have; it is a parameter of the operator, null by default: all count.
    """
    each = df.select(F.col(ident).alias("id"), F.explode(grams).alias("g")).distinct()
    if common is not None:
        rare = each.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") <= common).select("g")
        each = each.join(rare, "g", "left_semi")
    pairs = each.join(each.select(F.col("id").alias("other"), "g"), "g").where("other < id").groupBy("id", "other").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    if k is None:
        return pairs
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("shared").desc(), F.col("other")))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)
