"""Time: versions, as-of reads, gaps, intervals, day rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: Column | str) -> Column:
    """Seconds since the epoch, whatever the session's time zone, for timestamps without a zone."""
    return F.unix_micros(F.to_utc_timestamp(F.col(ts) if isinstance(ts, str) else ts, "UTC").cast("timestamp")) / 1_000_000


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by some columns. max_by over a struct aggregates before the shuffle, a window would not."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return picked.select(*keys, "row.*")


def latest_as_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], known: Column) -> DataFrame:
    """The last row of each key among those known at a time."""
    return latest(df.where(known), keys, order)


def as_of_join(left: DataFrame, right: DataFrame, key: str, time: str, right_time: str, values: Sequence[str], tie: str) -> DataFrame:
    """Each left row with the last right row of its key that is not later.

    Both sides are put in one stream and the last right value is carried forward, so a key's rows are sorted once and
    never joined with each other.
    """
    cols = [c for c in left.columns if c not in (key, time)]
    a = left.select(F.col(key), F.col(time).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(right.schema[tie].dataType).alias("tie"), F.struct(*cols).alias("l"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("v"))
    b = right.select(F.col(key), F.col(right_time).alias("t"), F.lit(0).alias("side"), F.col(tie).alias("tie"), F.lit(None).cast(left.select(F.struct(*cols).alias("l")).schema["l"].dataType).alias("l"), F.struct(*values).alias("v"))
    w = Window.partitionBy(key).orderBy("t", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = a.union(b).withColumn("v", F.last("v", ignorenulls=True).over(w)).where("side = 1")
    return carried.select(key, F.col("t").alias(time), "l.*", *[F.col("v")[x].alias(x) for x in values])


def changes_only(df: DataFrame, key: str, order: Sequence[str], state: str) -> DataFrame:
    """Rows whose state differs from the one before of their key (the first always does), with a running version."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(F.struct(state)).over(w)
    changed = df.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col("_before")[state].eqNullSafe(F.col(state))).drop("_before")
    return changed.withColumn("version", F.row_number().over(w))


def chain_faults(versions: DataFrame, key: str) -> DataFrame:
    """For each key: how many versions there are, the least and greatest, and how many links do not follow from the one before."""
    w = Window.partitionBy(key).orderBy("version")
    bad = F.col("version") != F.coalesce(F.lag("version").over(w), F.lit(0)) + 1
    return versions.withColumn("bad", bad).groupBy(key).agg(F.count("*").alias("n"), F.min("version").alias("least"), F.max("version").alias("greatest"), F.count_if("bad").alias("invalid"))


def longest_gap(df: DataFrame, key: str, ts: str, least: int = 10) -> DataFrame:
    """Each key's longest silence between distinct minutes, and the limit beyond which it counts as silent; keys with few minutes have none."""
    minutes = df.select(key, F.date_trunc("minute", ts).alias("t")).distinct()
    step = seconds("t") - seconds(F.lag("t").over(Window.partitionBy(key).orderBy("t")))
    gaps = minutes.withColumn("gap", step).groupBy(key).agg(F.count("*").alias("n"), F.max("gap").alias("longest"), F.max("t").alias("last_at")).where(F.col("n") >= least)
    return gaps.withColumn("limit_s", F.greatest(F.lit(12 * 3600.0), 1.5 * F.col("longest")))


def gaps(df: DataFrame, key: str, ts: str, minimum: float) -> DataFrame:
    """Stretches without rows longer than a minimum, from the latest time so far to the next row."""
    w = Window.partitionBy(key).orderBy(ts)
    so_far = F.max(ts).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.select(key, so_far.alias("started"), F.col(ts).alias("ended")).where(seconds("ended") - seconds("started") > minimum)


def islands(df: DataFrame, key: str, ts: str, limit: float) -> DataFrame:
    """Sessions: rows of a key that follow each other within a limit of seconds."""
    w = Window.partitionBy(key).orderBy(ts)
    starts = F.coalesce((seconds(ts) - F.lag(seconds(ts)).over(w) > limit).cast("int"), F.lit(1))
    numbered = df.withColumn("start", starts).withColumn("session", F.sum("start").over(w))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n"))


def without_overlap(new: DataFrame, known: DataFrame, bin_s: int = 3600) -> DataFrame:
    """New intervals (id, started, ended in seconds) that overlap no known one. Intervals are cut into bins, so the join has an equal key."""
    bins = lambda df: df.withColumn("bin", F.explode(F.sequence(F.floor(F.col("started") / bin_s), F.floor(F.col("ended") / bin_s))))
    k = bins(known).select("bin", F.col("started").alias("k_started"), F.col("ended").alias("k_ended"))
    hit = bins(new).join(k, "bin").where("started < k_ended and ended > k_started").select("id").distinct()
    return new.join(hit, "id", "left_anti")


def day_rollup(df: DataFrame, ts: str, measures: dict[str, Column]) -> DataFrame:
    """Measures for each day with zeros on days without rows, and each day's growth over the one before."""
    days = df.groupBy(F.to_date(ts).alias("day")).agg(*[c.alias(n) for n, c in measures.items()])
    span = df.agg(F.min(F.to_date(ts)).alias("a"), F.max(F.to_date(ts)).alias("z")).where("a is not null")
    spine = span.select(F.explode(F.sequence("a", "z")).alias("day"))
    full = spine.join(days, "day", "left").fillna(0, list(measures))
    first = next(iter(measures))
    return full.withColumn("growth", F.col(first) - F.lag(first).over(Window.orderBy("day")))  # one row for each day


def near_pairs(df: DataFrame, key: str, ident: str, ts: str, within: float) -> DataFrame:
    """Pairs (a before b by id) of a key's rows at most some seconds apart: time bins of that width and their neighbours, then the exact test."""
    left = df.select(key, F.col(ident).alias("a"), seconds(ts).alias("ta")).withColumn("bin", F.floor(F.col("ta") / within))
    right = df.select(key, F.col(ident).alias("b"), seconds(ts).alias("tb")).withColumn("bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("tb") / within) + d)))
    return left.join(right, [key, "bin"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) <= within)).select(key, "a", "b")


def retry_interval(interval: Column, failures: Column) -> Column:
    """Doubling waits after failures, eightfold and six hours at most, never below the interval."""
    return F.greatest(interval, F.least(interval * F.least(F.pow(F.lit(2), failures), F.lit(8)), F.lit(360)))


def next_due(due: Column, now: Column, every: Column) -> Column:
    """The next time of a schedule after now, by whole periods."""
    return F.when(due > now, due).otherwise(due + (F.floor((now - due) / every) + 1) * every)


def status_at(base: DataFrame, transitions: DataFrame, sequence: int) -> DataFrame:
    """Each id's status at a sequence number: that of its earliest terminal transition up to there, else its own."""
    ended = transitions.where(F.col("seq") <= sequence).groupBy("id").agg(F.min_by("status", "seq").alias("ended"))
    return base.join(ended, "id", "left").select("id", F.coalesce("ended", "status").alias("status"))
