"""Classification metrics as one-row DataFrames; none brings rows to the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(y: str, p: str) -> Column:
    """Equal labels; NaN equals nothing."""
    return F.coalesce((F.col(y) == F.col(p)) & ~F.isnan(F.col(y).cast("double")), F.lit(False))


def _share(top: Column, below: Column) -> Column:
    return F.when(below > 0, top / F.nullif(below, F.lit(0))).otherwise(F.lit(0.0)).cast("double")


def accuracy_score(df: DataFrame, y: str, p: str, normalize: bool = True) -> DataFrame:
    """``accuracy``: the share of equal labels, 0 without rows; or their number (bigint)."""
    hits = F.count_if(_same(y, p))
    return df.agg((_share(hits, F.count(F.lit(1))) if normalize else hits).alias("accuracy"))


def confusion_matrix(df: DataFrame, y: str, p: str, labels: Sequence[int] | None = None, dense: bool = True) -> DataFrame:
    """(actual, predicted, n) for all pairs of labels, those that never occur with 0.

    By default the labels are those of either column; with ``labels``, other rows are left out.
    With ``dense=False`` only pairs that occur have a row, so that very many labels do no harm.
    """
    counts = df.groupBy(F.col(y).cast("int").alias("actual"), F.col(p).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    if labels is None:
        # It keeps the counts and joins null-safely, so that all three uses share one scan and one exchange.
        known = counts.select(F.explode(F.array("actual", "predicted")).alias("label"), "n").groupBy("label").agg(F.sum("n").alias("n")).where("label is not null and n > 0").select("label")
    else:
        known = df.sparkSession.createDataFrame([(int(v),) for v in labels], "label int").distinct()
    if not dense:
        for side in ("actual", "predicted"):
            counts = counts.join(known.withColumnRenamed("label", side), side, "left_semi")
        return counts.select("actual", "predicted", "n")
    # The result has a row per pair of labels by definition; it is made of the labels, not of rows.
    cells = known.select(F.col("label").alias("actual")).crossJoin(known.select(F.col("label").alias("predicted")))
    c = counts.select(F.col("actual").alias("a"), F.col("predicted").alias("b"), "n")
    return cells.join(c, F.col("actual").eqNullSafe(F.col("a")) & F.col("predicted").eqNullSafe(F.col("b")), "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def _per_class(df: DataFrame, y: str, p: str) -> DataFrame:
    """(label, hits, actual, predicted) of each class that occurs in ``y``."""
    counts = df.groupBy(F.col(y).alias("a"), F.col(p).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    side = F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted"), F.when(_same("a", "b"), F.col("n")).otherwise(0).alias("hits")), F.struct(F.col("b").alias("label"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits"))))
    rows = counts.select(side.alias("s")).select("s.*").where("label is not null")
    return rows.groupBy("label").agg(F.sum("hits").alias("hits"), F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted")).where("actual > 0")


def _score(df: DataFrame, y: str, p: str, average: str, positive: int, name: str) -> DataFrame:
    of = {"precision": "predicted", "recall": "actual"}[name]
    if average == "binary":
        hits = F.count_if((F.col(y) == positive) & (F.col(p) == positive))
        return df.agg(_share(hits, F.count_if(F.col(p if name == "precision" else y) == positive)).alias(name))
    if average == "macro":
        return _per_class(df, y, p).agg(F.coalesce(F.avg(_share(F.col("hits"), F.col(of))), F.lit(0.0)).alias(name))
    if average == "micro":
        return accuracy_score(df, y, p).withColumnRenamed("accuracy", name)
    raise ValueError(f"average is 'binary', 'macro' or 'micro', not {average!r}")


def precision_score(df: DataFrame, y: str, p: str, average: str = "binary", positive: int = 1) -> DataFrame:
    """``precision``; 0 where it is undefined. macro: the mean over the classes of ``y``; micro: the accuracy."""
    return _score(df, y, p, average, positive, "precision")


def recall_score(df: DataFrame, y: str, p: str, average: str = "binary", positive: int = 1) -> DataFrame:
    """``recall``; see precision_score."""
    return _score(df, y, p, average, positive, "recall")


def f1_score(df: DataFrame, y: str, p: str, average: str = "binary", positive: int = 1) -> DataFrame:
    """``f1`` of the averaged precision and recall, from one aggregation; 0 if both are 0."""
    if average == "binary":
        hits = F.count_if((F.col(y) == positive) & (F.col(p) == positive))
        both = df.agg(_share(hits, F.count_if(F.col(p) == positive)).alias("precision"), _share(hits, F.count_if(F.col(y) == positive)).alias("recall"))
    elif average == "macro":
        both = _per_class(df, y, p).agg(F.coalesce(F.avg(_share(F.col("hits"), F.col("predicted"))), F.lit(0.0)).alias("precision"), F.coalesce(F.avg(_share(F.col("hits"), F.col("actual"))), F.lit(0.0)).alias("recall"))
    elif average == "micro":
        both = accuracy_score(df, y, p).select(F.col("accuracy").alias("precision"), F.col("accuracy").alias("recall"))
    else:
        raise ValueError(f"average is 'binary', 'macro' or 'micro', not {average!r}")
    total = F.col("precision") + F.col("recall")
    return both.select(F.when(total > 0, 2 * F.col("precision") * F.col("recall") / F.nullif(total, F.lit(0.0))).otherwise(F.lit(0.0)).alias("f1"))


def log_loss(df: DataFrame, y: str, proba: str, eps: float = 1e-15) -> DataFrame:
    """``log_loss``: mean of -ln of the probability at the label's place, clipped; a missing place counts as eps; 0 without rows.

    A label that is no whole number, NaN included, has no place.
    """
    label = F.col(y).cast("double")
    place = label.try_cast("int")
    given = F.coalesce(F.when(place == label, F.get(F.col(proba).cast("array<double>"), place)), F.lit(eps))
    clipped = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), given))
    return df.agg(F.coalesce(F.avg(-F.ln(clipped)), F.lit(0.0)).alias("log_loss"))
