"""Statistics: classification and agreement metrics, calibration, basis points, gates, fingerprints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The normal quantile of a 95 % interval (fixed value).
Z95 = 1.959963984540054


def bps(part: Column, whole: Column) -> Column:
    """Basis points by floor division; an empty whole is complete."""
    return F.when(whole == 0, F.lit(10_000).cast("bigint")).otherwise(F.floor(part * 10_000 / F.nullif(whole, F.lit(0))).cast("bigint"))


def wilson(right: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson interval of a share; (0, 0) of nothing."""
    p, d = F.try_divide(right, n), 1 + F.try_divide(F.lit(z * z), n)
    mid = (p + F.try_divide(F.lit(z * z / 2), n)) / d
    half = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n)) / d
    return F.coalesce(F.greatest(mid - half, F.lit(0.0)), F.lit(0.0)), F.coalesce(F.least(mid + half, F.lit(1.0)), F.lit(0.0))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """label, support, predicted, right, precision, recall, f1 for each label on either side; a share of nothing is null."""
    each = df.select(F.explode(F.array(
        F.struct(F.col(actual).alias("label"), F.lit(1).alias("s"), F.lit(0).alias("p"), F.lit(0).alias("r")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).alias("s"), F.lit(1).alias("p"), (F.col(actual) == F.col(predicted)).cast("int").alias("r")),
    )).alias("x")).select("x.*").where("label is not null")
    out = each.groupBy("label").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("r").alias("right"))
    precision, recall = F.try_divide(F.col("right"), F.col("predicted")), F.try_divide(F.col("right"), F.col("support"))
    return out.withColumns({"precision": precision, "recall": recall, "f1": F.when(precision.isNotNull() & recall.isNotNull(), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)))})


def accuracy(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """n, right, accuracy and its Wilson interval, overall or by group."""
    agg = df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(F.col(actual) == F.col(predicted)).alias("right"))
    low, high = wilson(F.col("right"), F.col("n"))
    return agg.select(*(by or []), "n", "right", F.try_divide("right", "n").alias("accuracy"), low.alias("low"), high.alias("high"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, observed and expected agreement and Cohen's kappa (null if agreement by chance is certain), from one pass of marginals."""
    pairs = df.groupBy(a, b).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col(a).alias("label"), F.col("n").alias("x"), F.lit(0).cast("bigint").alias("y")), F.struct(F.col(b).alias("label"), F.lit(0).cast("bigint").alias("x"), F.col("n").alias("y")))).alias("s")).select("s.*")
    products = sides.groupBy("label").agg((F.sum("x") * F.sum("y")).alias("xy")).agg(F.sum("xy").alias("xy"))
    total = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    both = total.crossJoin(products)  # one row each
    observed, expected = F.try_divide("same", "n"), F.try_divide("xy", F.col("n") * F.col("n"))
    return both.select("n", observed.alias("observed"), expected.alias("expected"), F.when(expected < 1, (observed - expected) / (1 - expected)).alias("kappa"))


def reliability(df: DataFrame, probability: str, right: str, bins: int = 10) -> DataFrame:
    """bin, n, mean probability, share right; the last bin is closed."""
    b = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("confidence"), F.avg(right).alias("share"))


def calibration(df: DataFrame, probability: str, right: str, bins: int = 10) -> DataFrame:
    """Expected calibration error and Brier score."""
    by = reliability(df, probability, right, bins)
    ece = by.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("share"))) / F.sum("n")).alias("ece"))
    brier = df.agg(F.avg(F.pow(F.col(probability) - F.col(right), F.lit(2))).alias("brier"))
    return ece.crossJoin(brier)  # one row each


def temperature(buckets: list[tuple[float, int, int]], low: float = -3.0, high: float = 3.0, steps: int = 80) -> tuple[float, float]:
    """The temperature that makes logits most likely, by golden section on its logarithm, and the loss there.

    buckets: (logit, right, n) of aggregated rows; there are as many as distinct logits.
    """

    def loss(log_t: float) -> float:
        t, total, weight = math.exp(log_t), 0.0, 0
        for logit, right, n in buckets:
            z = logit / t
            total += right * math.log1p(math.exp(-z)) + (n - right) * math.log1p(math.exp(z)) if abs(z) < 500 else (n - right) * z if z > 0 else right * -z
            weight += n
        return total / weight

    g = (math.sqrt(5) - 1) / 2
    a, z = low, high
    p, q = z - g * (z - a), a + g * (z - a)
    fp, fq = loss(p), loss(q)
    for _ in range(steps):
        if fp <= fq:
            z, q, fq = q, p, fp
            p = z - g * (z - a)
            fp = loss(p)
        else:
            a, p, fp = p, q, fq
            q = a + g * (z - a)
            fq = loss(q)
    best = (a + z) / 2
    return math.exp(best), loss(best)


def nearest_rank(df: DataFrame, value: str, by: list[str], shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.expr(f"percentile_disc({s}) within group (order by {value})").alias(f"p{round(100 * s)}") for s in shares])


def coverage(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """name, covered, total, percent for each condition, in one pass."""
    totals = df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(f"c_{n}") for n, c in parts.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"c_{n}").alias("covered"), F.col("total")) for n in parts]))
    return totals.select(rows.alias("x")).select("x.*").withColumn("percent", F.round(F.coalesce(F.try_divide(100.0 * F.col("covered"), F.col("total")), F.lit(0.0)), 2))


def gate(metrics: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """metrics with the names of checks that fail, and whether none does; a check on a null fails."""
    failed = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return metrics.withColumn("failed", F.array_join(failed, ",")).withColumn("passed", F.size(failed) == 0)


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows and an order-free digest: the sum of the leading 60 bits of each row's SHA-256, in which repeated rows count; values are length-prefixed, null is '-'."""
    text = F.concat_ws("", *[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns])
    head = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")
    return df.select(head.alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")).cast("string"), F.lit("0")).alias("digest"))


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each column alone and overall, in one pass with grouping sets; all_<column>s tells rows over all of its values."""
    flags = [F.grouping(c).cast("int").alias(f"all_{c}s") for c in columns]
    return df.groupingSets([*[[c] for c in columns], []], *columns).agg(F.count("*").alias("n"), *flags)


def shadow(df: DataFrame, outcome: str) -> DataFrame:
    """Counts of outcomes as basis points of all, and whether errors and disagreements stay low."""
    out = df.agg(F.count("*").alias("n"), F.count_if(F.col(outcome) == "error").alias("errors"), F.count_if(F.col(outcome) == "disagree").alias("disagreements"))
    rate = lambda c: F.floor(F.col(c) * 10_000 / F.greatest("n", F.lit(1))).cast("bigint")
    return out.select("*", rate("errors").alias("error_bps"), rate("disagreements").alias("disagreement_bps"))
