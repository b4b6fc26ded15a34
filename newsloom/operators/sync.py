"""Change feeds, snapshots and keyed state; sampling; audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import kept


def changes(log: DataFrame, cursor: int, high_water: int, kinds: list[str], limit: int) -> DataFrame:
    """The next changes after a cursor up to the high water, of some kinds."""
    return log.where((F.col("seq") > cursor) & (F.col("seq") <= high_water) & F.col("kind").isin(kinds)).orderBy("seq").limit(limit)


def snapshot(log: DataFrame, high_water: int) -> DataFrame:
    """The latest change of each resource up to the high water; withdrawn resources are left out."""
    rest = [c for c in log.columns if c != "resource"]
    last = log.where(F.col("seq") <= high_water).groupBy("resource").agg(F.max_by(F.struct(*rest), "seq").alias("row"))
    return last.select("resource", "row.*").where("kind <> 'delete'")


def pages(snap: DataFrame, size: int, payload: Column) -> DataFrame:
    """Pages of a snapshot in byte order of the resource, with the hash of each page's canonical rows.

    Ranks come from range-partitioned counts, not from one sorted task: rows are dealt to pages by their exact place.
    """
    placed = place(snap.withColumn("_row", payload), "resource").withColumn("page", F.floor((F.col("place") - 1) / size).cast("bigint"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "_row"))), lambda x: x["_row"]), ",")
    return placed.groupBy("page").agg(F.count("*").alias("n"), F.sha2(F.concat(F.lit("["), rows, F.lit("]")), 256).alias("sha256"))


def place(df: DataFrame, key: str, buckets: int = 4096) -> DataFrame:
    """df with each row's place (from 1) in the order of a unique key.

    Rows are dealt into ranges of the key; counts of ranges give where each begins, and a window ranks rows within a
    range only.
    """
    parts = max(1, min(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2))
    # the whole key, so that keys with a common beginning spread as well; written once, as ranges may fall differently when worked out again
    ranged = kept(df.repartitionByRange(parts, key).withColumn("_bucket", F.spark_partition_id()))
    counts = ranged.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).drop("_n")  # one row for each bucket
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return ranged.join(F.broadcast(before), "_bucket").withColumn("place", F.col("_before") + rank).drop("_bucket", "_before")


def apply_changes(state: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """A keyed state after changes: the last writer by seq wins, deletes remove."""
    cols = [c for c in state.columns if c != key]
    both = state.select(key, *cols, F.lit("update").alias("op")).unionByName(log.select(key, *cols, "op"))
    last = both.groupBy(key).agg(F.max_by(F.struct(*cols, "op"), "seq").alias("row"))
    return last.select(key, "row.*").where("op <> 'delete'").drop("op")


def idempotent(log: DataFrame, key: str, payload: str) -> DataFrame:
    """Keys, how often they were published, and whether a later payload differed (a conflict)."""
    return log.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(payload).alias("payloads"), F.min("seq").alias("first_seq")).withColumn("conflict", F.col("payloads") > 1)


def sample_per_stratum(df: DataFrame, stratum: str, ident: str, seed: str, k: int) -> DataFrame:
    """The k rows of each stratum with the smallest SHA-256 of seed and id."""
    draw = F.sha2(F.concat(F.lit(seed + ":"), F.col(ident).cast("string")), 256)
    w = Window.partitionBy(stratum).orderBy("draw", ident)
    return df.withColumn("draw", draw).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def round_robin(df: DataFrame, stratum: str, ident: str, seed: str, limit: int) -> DataFrame:
    """Rows taken one from each stratum in turn, strata by the hash of their name, rows by the hash of their id.

    No stratum gives more rows than the limit, so ranks beyond it are cut before the final bounded sort.
    """
    ranked = sample_per_stratum(df, stratum, ident, seed, limit)
    turn = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col(stratum).cast("string"), F.lit(""))), 256)
    return ranked.withColumn("turn", turn).orderBy("rank", "turn", ident).limit(limit)


def report(df: DataFrame, stratum: str, status: str) -> DataFrame:
    """Counts and basis points by stratum and overall (stratum null) in one pass with rollup."""
    out = df.rollup(stratum).agg(F.count("*").alias("n"), F.count_if(F.col(status) == "accepted").alias("accepted"), F.count_if(F.col(status) == "rejected").alias("rejected"), F.grouping(stratum).alias("overall"))
    decided = F.col("accepted") + F.col("rejected")
    return out.withColumn("decided_bps", F.floor(decided * 10_000 / F.col("n")).cast("bigint")).withColumn("acceptance_bps", F.when(decided > 0, F.floor(F.col("accepted") * 10_000 / F.greatest(decided, F.lit(1)))).cast("bigint"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: how many rows break each rule, in one pass; a null condition is no violation."""
    counts = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])).alias("x")).select("x.*")


def missing_references(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key no parent has."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def reconcile(have: DataFrame, want: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """What must happen to each key so that have becomes want: add, update, retire or keep."""
    h = have.select(F.col(key), F.struct(*compare).alias("h"))
    w = want.select(F.col(key), F.struct(*compare).alias("w"))
    action = F.when(F.col("h").isNull(), "add").when(F.col("w").isNull(), "retire").when(F.col("h").eqNullSafe(F.col("w")), "keep").otherwise("update")
    return h.join(w, key, "full").select(key, action.alias("action"))


def budget(attempts: DataFrame, by: list[str], order: str, cost: str, limit: int) -> DataFrame:
    """Attempts with what their group has reserved before, and whether the next fits the budget."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.greatest(F.col(cost), F.lit(0))).over(w), F.lit(0))
    return attempts.withColumn("spent", spent).withColumn("fits", F.col("spent") + F.col(cost) <= limit)
