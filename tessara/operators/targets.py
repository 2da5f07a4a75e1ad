"""What kind of target a column holds, and class and sample weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def type_of_target(df: DataFrame, y: str) -> DataFrame:
    """``type_of_target``: 'continuous' with any non-integer (NaN and infinities too), 'binary' up to two labels, else 'multiclass'."""
    v = F.col(y).cast("double")
    odd = F.count_if(F.isnan(v) | (F.abs(v) == float("inf")) | (v != F.floor(v)))
    return df.agg(F.when(odd > 0, "continuous").when(F.count_distinct(v) <= 2, "binary").otherwise("multiclass").alias("type_of_target"))


def unique_labels(*columns: tuple[DataFrame, str]) -> DataFrame:
    """``label``: the ascending distinct union of (df, column) pairs."""
    out = None
    for df, c in columns:
        part = df.select(F.col(c).alias("label"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("at least one column is needed")
    return out.where("label is not null").distinct().orderBy("label")


def is_binary_classification(df: DataFrame, y: str) -> DataFrame:
    return df.agg((F.count_distinct(y) == 2).alias("is_binary"))


def is_multilabel(df: DataFrame, y: str) -> bool:
    """Never: a target is one column."""
    return False


def class_count(df: DataFrame, y: str) -> DataFrame:
    return df.agg(F.count_distinct(y).alias("class_count"))


def check_classification_targets(df: DataFrame, y: str) -> None:
    """ValueError for a continuous target."""
    if type_of_target(df, y).first()[0] == "continuous":
        raise ValueError("the target is continuous")


def _balanced(df: DataFrame, y: str, n_classes: int | None = None) -> DataFrame:
    """(class, weight) from one aggregate and its totals, which are one row."""
    counts = df.groupBy(F.col(y).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    k = F.count("class") if n_classes is None else F.lit(n_classes)
    total = counts.agg((F.sum("n") / k).alias("__each"))
    return counts.crossJoin(F.broadcast(total)).select("class", (F.col("__each") / F.col("n")).alias("weight"))


def compute_class_weight(weight: str | Mapping[int, float], classes: Sequence[int], df: DataFrame, y: str) -> DataFrame:
    """(class, weight). balanced: all rows / (number of classes * rows of the class), ValueError if a class has none."""
    spark = df.sparkSession
    wanted = [int(c) for c in classes]
    if weight == "balanced":
        known = spark.createDataFrame([(c,) for c in wanted], "class int")
        found = F.broadcast(known).join(_balanced(df, y, len(wanted)).withColumn("class", F.col("class").cast("int")), "class", "left")
        lost = [r[0] for r in found.where("weight is null").select("class").collect()]
        if lost:
            raise ValueError(f"classes without rows: {lost}")
        return found.select("class", "weight")
    if isinstance(weight, str):
        raise ValueError("weight is 'balanced' or a mapping")
    lost = [c for c in wanted if c not in weight]
    if lost:
        raise ValueError(f"classes without a weight: {lost}")
    return spark.createDataFrame([(c, float(weight[c])) for c in wanted], "class int, weight double")


def compute_sample_weight(weight: str | Mapping[int, float], df: DataFrame, y: str) -> DataFrame:
    """``df`` with ``weight``, that of each row's class; classes are the distinct labels."""
    if weight == "balanced":
        # One row per class: Spark broadcasts it when its measured size allows.
        table = _balanced(df, y).withColumnRenamed("class", "__class")
        return df.join(table, F.col(y) == F.col("__class")).drop("__class")
    if isinstance(weight, str):
        raise ValueError("weight is 'balanced' or a mapping")
    lost = [r[0] for r in df.select(y).distinct().where(~F.col(y).isin(list(weight))).limit(10).collect()]
    if lost:
        raise ValueError(f"classes without a weight: {lost}")
    return df.withColumn("weight", mapped_weight(weight, y))


def mapped_weight(weight: Mapping[int, float], y: str) -> Column:
    pairs = [F.lit(v) for c, w in weight.items() for v in (int(c), float(w))]
    return F.element_at(F.create_map(*pairs), F.col(y).cast("int"))
