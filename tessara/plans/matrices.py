"""Matrices in long form: (i, j, v), one row per entry."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Columns up to which gram() works on dense rows.
DENSE = 2048


def long_form(df: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of an array column as entries (key, position, value)."""
    keyed = df.select(F.col(key).alias("i"), F.col(column).cast("array<double>").alias("x"))
    return keyed.select("i", F.posexplode("x").alias("j", "v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B. Entries of A that are 0 are left out first, so 0 on the left times anything is 0."""
    left = a.where("v <> 0").select("i", F.col("j").alias("k"), F.col("v").alias("a"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("b"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def gram(a: DataFrame) -> DataFrame:
    """A'A of a long matrix whose columns are numbered from 0.

    Up to DENSE columns, each row's entries are brought together and multiplied
    in dense blocks, whose sums alone are shuffled; wider matrices are joined.
    """
    width = a.agg(F.coalesce(F.max("j"), F.lit(-1)).alias("j")).first()["j"] + 1
    if width > DENSE:
        return matmul(transpose(a), a)
    ship(a.sparkSession)
    rows = a.groupBy("i").agg(F.collect_list("j").alias("j"), F.collect_list("v").alias("v")).select("j", "v")

    def run(batches):
        total, seen = np.zeros((width, width)), np.zeros(width, bool)
        for b in batches:
            for part in (b.slice(k, 1024) for k in range(0, b.num_rows, 1024)):
                at = np.repeat(np.arange(part.num_rows), part.column("j").value_lengths().to_numpy())
                x, j = np.zeros((part.num_rows, width)), part.column("j").flatten().to_numpy()
                np.add.at(x, (at, j), part.column("v").flatten().to_numpy(zero_copy_only=False))
                total += x.T @ x
                seen[j] = True
        i, j = np.nonzero(seen[:, None] & seen[None, :])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    found = rows.mapInArrow(run, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    kind = a.schema["j"].dataType
    return found.select(F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j"), "v")


def add_diagonal(a: DataFrame, alpha: float) -> DataFrame:
    return a.withColumn("v", F.col("v") + F.when(F.col("i") == F.col("j"), F.lit(float(alpha))).otherwise(F.lit(0.0)))


def times_vector(a: DataFrame, y: DataFrame) -> DataFrame:
    """A'y: ``y`` has (i, y)."""
    return a.join(y, "i").groupBy("j").agg(F.sum(F.col("v") * F.col("y")).alias("v"))
