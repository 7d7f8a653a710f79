"""Scores of predictions. Every classification metric is read off the confusion counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import PER_RANGE, running_sums

RUN = ("fold", "feature", "model")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def f1_of(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def confusion_counts(pred: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """(by, y_true, y_pred, n)."""
    return pred.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(pred: DataFrame, classes: Sequence[int] = (0, 1), by: Sequence[str] = RUN) -> DataFrame:
    """One row per true class with a column pred_<class> for each predicted class."""
    cells = confusion_counts(pred, by)
    return cells.groupBy(*by, "y_true").agg(
        *[F.sum(F.when(F.col("y_pred") == c, F.col("n")).otherwise(0)).alias(f"pred_{c}") for c in classes]
    )


def metrics_per_class(pred: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """Precision, recall, F1 and support of every class seen as a label or a prediction."""
    cells = confusion_counts(pred, by)
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    sides = cells.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.col("y_true").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted"), hit.alias("hit")),
                F.struct(F.col("y_pred").alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hit")),
            )
        ),
    )
    sums = sides.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "hit")])
    precision = ratio(F.col("hit"), F.col("predicted"))
    recall = ratio(F.col("hit"), F.col("actual"))
    return sums.select(
        *by,
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        f1_of(precision, recall).alias("f1"),
        F.col("actual").alias("support"),
    )


def metrics_table(pred: DataFrame, positive: int = 1, by: Sequence[str] = RUN) -> DataFrame:
    """Accuracy, and precision, recall, F1 of the positive class, per run in one aggregation."""
    true, guess = F.col("y_true") == positive, F.col("y_pred") == positive

    def count_if(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0))

    sums = pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        count_if(F.col("y_true") == F.col("y_pred")).alias("right"),
        count_if(true & guess).alias("tp"),
        count_if(guess).alias("guessed"),
        count_if(true).alias("actual"),
    )
    precision, recall = ratio(F.col("tp"), F.col("guessed")), ratio(F.col("tp"), F.col("actual"))
    return sums.select(
        *by,
        ratio(F.col("right"), F.col("n")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1_of(precision, recall).alias("f1"),
    )


def regression_metrics(pred: DataFrame, by: Sequence[str] = RUN) -> DataFrame:
    """MSE, RMSE, MAE and R2 of ``y_pred`` against ``y_true``.

    The spread of the true values comes from a variance aggregate, which is stable where a
    difference of sums of squares is not. A constant target scores 1 if met and 0 if not.
    """
    miss = F.col("y_true") - F.col("y_pred")
    sums = pred.groupBy(*by).agg(
        F.avg(miss * miss).alias("mse"),
        F.avg(F.abs(miss)).alias("mae"),
        F.var_pop("y_true").alias("spread"),
    )
    r2 = F.when(F.col("spread") > 0, 1 - F.col("mse") / F.col("spread")).otherwise(
        F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    )
    return sums.select(*by, "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"))


def roc_auc(pred: DataFrame, by: Sequence[str] = RUN, positive: int = 1, per_range: int = PER_RANGE) -> DataFrame:
    """Area under the ROC curve, exact, with ties counted half; NULL where one class is missing.

    Rows are first reduced to counts per distinct score. The negatives below each score are then running sums over
    ranges of scores, as many as the number of distinct scores asks for, so no task sorts more than its range.
    """
    is_pos = F.col("y_true") == positive
    counts = pred.groupBy(*by, "score").agg(
        F.sum(F.when(is_pos, 1.0).otherwise(0.0)).alias("pos"),
        F.sum(F.when(is_pos, 0.0).otherwise(1.0)).alias("neg"),
    )
    placed = running_sums(counts, ["score"], {"below": F.col("neg")}, by, per_range)
    won = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    sums = placed.groupBy(*by).agg(won.alias("won"), (F.sum("pos") * F.sum("neg")).alias("pairs"))
    return sums.select(*by, F.when(F.col("pairs") > 0, F.col("won") / F.col("pairs")).alias("auc"))
