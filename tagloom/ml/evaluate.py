"""Scores of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_counts(rows: DataFrame, truth: str, predicted: str, threshold: float = 0.5) -> DataFrame:
    """One row: true and false positives and negatives; confidences are cut at the threshold, nulls count nowhere."""
    t, p = F.col(truth) >= threshold, F.col(predicted) >= threshold
    count = lambda c: F.count(F.when(c, 1))
    return rows.agg(count(t & p).alias("tp"), count(~t & ~p).alias("tn"), count(~t & p).alias("fp"), count(t & ~p).alias("fn"))


def metrics(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """Accuracy, precision, recall and F-beta; 0 / 0 gives null."""
    c = F.col
    b = beta * beta
    ratio = lambda x, y: F.round(F.try_divide(x.cast("double"), y.cast("double")), 9)
    return counts.select(
        ratio(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")).alias("accuracy"),
        ratio(c("tp"), c("tp") + c("fp")).alias("precision"),
        ratio(c("tp"), c("tp") + c("fn")).alias("recall"),
        ratio((1 + b) * c("tp"), (1 + b) * c("tp") + b * c("fn") + c("fp")).alias("f_beta"),
    )


def confusion_matrix(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``truth, predicted, n``."""
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def summary(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: judged rows, the right and the wrong ones, the share of right ones and kappa; rows with a null are not judged."""
    cells = confusion_matrix(rows.dropna(subset=[truth, predicted]), truth, predicted)
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("judged"), F.coalesce(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n"))), F.lit(0)).alias("right"))
    sides = cells.groupBy(F.col("truth").alias("c")).agg(F.sum("n").alias("x")).join(cells.groupBy(F.col("predicted").alias("c")).agg(F.sum("n").alias("y")), "c")
    chance = sides.agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("meet"))
    both = total.join(F.broadcast(chance), how="cross")  # one row each
    share, by_chance = F.try_divide(F.col("right").cast("double"), F.col("judged")), F.try_divide(F.col("meet"), F.col("judged").cast("double") * F.col("judged"))
    return both.select("judged", "right", (F.col("judged") - F.col("right")).alias("wrong"), F.round(share, 9).alias("accuracy"), F.round(F.try_divide(share - by_chance, 1 - by_chance), 9).alias("kappa"))


def class_details(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``label, rows, precision, recall, f1`` of every class seen on either side; 0 / 0 gives null."""
    cells = confusion_matrix(rows.dropna(subset=[truth, predicted]), truth, predicted)
    ends = F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("own"), F.lit(0).cast("long").alias("said")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("own"), F.col("n").alias("said")))
    right = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = cells.select(F.explode(ends).alias("e"), right.alias("right")).groupBy("e.label").agg(F.sum("e.own").alias("rows"), F.sum("e.said").alias("said"), (F.sum("right") / 2).alias("right"))
    ratio = lambda x, y: F.round(F.try_divide(x.cast("double"), y.cast("double")), 9)
    c = F.col
    return sides.select("label", "rows", ratio(c("right"), c("said")).alias("precision"), ratio(c("right"), c("rows")).alias("recall"), ratio(2 * c("right"), c("rows") + c("said")).alias("f1"))
