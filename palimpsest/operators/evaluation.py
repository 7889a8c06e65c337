"""Evaluation: classification metrics, calibration, thresholds, text agreement, percentiles, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_f1(df: DataFrame, key: str, prediction: Column, reference: Column) -> DataFrame:
    """(key, f1): harmonic mean of precision and recall over words counted with repetition; 0 where nothing is shared.

    Rows of one key count separately if they differ; a row with an empty side has 0 unless both are empty, then 1.
    """
    rows = df.select(key, prediction.alias("_p"), reference.alias("_r")).distinct().withColumn("_row", F.xxhash64(key, "_p", "_r"))
    sides = [rows.select("_row", F.explode(c).alias("w")).groupBy("_row", "w").agg(F.count(F.lit(1)).alias(n)) for c, n in (("_p", "p"), ("_r", "r"))]
    same = sides[0].join(sides[1], ["_row", "w"]).groupBy("_row").agg(F.sum(F.least("p", "r")).alias("same"))
    both = rows.join(same, "_row", "left").withColumn("same", F.coalesce("same", F.lit(0)))
    total = F.size("_p") + F.size("_r")
    return both.select(key, F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.col("same") / total).alias("f1"))


def classification_report(df: DataFrame, truth: Column, predicted: Column, *group: str) -> DataFrame:
    """Precision, recall, F1 and false positive rate; a ratio without cases is 0."""
    c = lambda cond, n: F.count_if(cond).alias(n)
    g = df.groupBy(*group).agg(c(truth & predicted, "tp"), c(~truth & predicted, "fp"), c(truth & ~predicted, "fn"), c(~truth & ~predicted, "tn"))
    r = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))
    p, q = r("tp", F.col("tp") + F.col("fp")), r("tp", F.col("tp") + F.col("fn"))
    return g.select(*group, "tp", "fp", "fn", "tn", p.alias("precision"), q.alias("recall"), F.coalesce(F.try_divide(2 * p * q, p + q), F.lit(0.0)).alias("f1"), r("fp", F.col("fp") + F.col("tn")).alias("fpr"))


def calibrate_temperature(df: DataFrame, logit: str, truth: Column, grid: list[float]) -> DataFrame:
    """(temperature, brier): the grid's temperature of the least mean squared error, ties to the lower one."""
    each = df.select(F.col(logit).alias("_z"), truth.cast("double").alias("_y"), F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("temperature"))
    p = 1.0 / (1.0 + F.exp(-F.col("_z") / F.col("temperature")))
    by = each.groupBy("temperature").agg(F.round(F.avg((p - F.col("_y")) * (p - F.col("_y"))), 9).alias("brier"))
    return by.orderBy("brier", "temperature").limit(1)


def tune_threshold(df: DataFrame, score: str, truth: Column, grid: list[float], most_contamination: float) -> DataFrame:
    """(threshold, recall, contamination): the best recall whose share of false rows among the taken stays in the limit.

    Where no threshold keeps the limit, the least contaminated one. Ties go to the higher threshold.
    """
    each = df.select(F.col(score).alias("_s"), truth.alias("_y"), F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("threshold"))
    taken = F.col("_s") >= F.col("threshold")
    by = each.groupBy("threshold").agg(
        F.coalesce(F.try_divide(F.count_if(taken & F.col("_y")).cast("double"), F.count_if(F.col("_y"))), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(F.count_if(taken & ~F.col("_y")).cast("double"), F.count_if(taken)), F.lit(0.0)).alias("contamination"),
    )
    ok = (F.col("contamination") <= most_contamination).cast("int")
    return by.withColumn("_ok", ok).orderBy(F.col("_ok").desc(), F.when(F.col("_ok") == 1, -F.col("recall")).otherwise(F.col("contamination")), F.col("threshold").desc()).limit(1).drop("_ok")


def positional_percentile(df: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """(group, value): the value at position ceil(share x n) in order, no interpolation."""
    w = Window.partitionBy(group)
    r = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    return r.where(F.col("_r") == F.ceil(F.col("_n") * share)).select(group, value)


def beta_lower_bound(good: Column, bad: Column, z: float = 1.0) -> Column:
    """Mean minus z standard deviations of a Beta(good + 1, bad + 1) belief."""
    a, b = good + 1.0, bad + 1.0
    n = a + b
    return a / n - z * F.sqrt(a * b / (n * n * (n + 1.0)))
