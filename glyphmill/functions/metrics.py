"""Precision, recall and their relatives from counts, with the rules for nothing to count.

Precision and recall are null where their denominator is 0.  F1 is 0 where there are no
hits but some misses or false alarms, and null where there is nothing at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a.cast("double") / b)


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = precision(tp, fp), recall(tp, fn)
    return F.when(tp + fp + fn == 0, F.lit(None).cast("double")).when(tp == 0, F.lit(0.0)).otherwise(2.0 * p * r / (p + r))


def with_scores(df: DataFrame) -> DataFrame:
    """``df`` with tp, fp, fn and precision, recall, f1."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns({"precision": precision(tp, fp), "recall": recall(tp, fn), "f1": f1(tp, fp, fn)})


def set_scores(gold: DataFrame, predicted: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Scores of two sets of ``keys``, by group: distinct rows on either side, one full outer join."""
    by = by or []
    left = gold.select(*keys).distinct().withColumn("gm_gold", F.lit(True))
    right = predicted.select(*keys).distinct().withColumn("gm_pred", F.lit(True))
    both = left.join(right, keys, "full_outer")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    g, p = F.col("gm_gold").isNotNull(), F.col("gm_pred").isNotNull()
    return with_scores(both.groupBy(*by).agg(one(g & p).alias("tp"), one(~g & p).alias("fp"), one(g & ~p).alias("fn")))


def macro_f1(per_label: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean F1 over labels with support."""
    return per_label.groupBy(*(by or [])).agg(F.avg(F.when(F.col("tp") + F.col("fn") > 0, F.col("f1"))).alias("macro_f1"))


def bin_of(confidence: Column, bins: int = 10) -> Column:
    """Equal-width bin from 0; the last is closed."""
    return F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("int")


def calibration_bins(df: DataFrame, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Rows of confidence and correct (0 or 1): count, mean confidence, accuracy and squared error of each bin."""
    c, y = F.col("confidence"), F.col("correct").cast("double")
    return df.groupBy(*(by or []), bin_of(c, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean_confidence"), F.avg(y).alias("accuracy"), F.sum((c - y) * (c - y)).alias("squared_error"))


def calibration(binned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Brier score and expected calibration error; pools bins of equal groups by their counts."""
    by = by or []
    pooled = binned.groupBy(*by, "bin").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean_confidence")) / F.sum("n")).alias("c"), (F.sum(F.col("n") * F.col("accuracy")) / F.sum("n")).alias("a"), F.sum("squared_error").alias("e"))
    return pooled.groupBy(*by).agg(F.sum("n").alias("n"), ratio(F.sum("e"), F.sum("n")).alias("brier"), ratio(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))), F.sum("n")).alias("ece"))
