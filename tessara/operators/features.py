"""How operators name their features: number columns, or one array column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Features:
    """Either a list of number columns or the name of an array column."""

    def __init__(self, columns: str | Sequence[str]):
        self.columns = columns if isinstance(columns, str) else list(columns)
        self.is_array = isinstance(columns, str)

    def width(self, df: DataFrame) -> int:
        """Number of features; of an array column, that of the first row (0 if there is none)."""
        if not self.is_array:
            return len(self.columns)
        row = df.select(F.size(self.columns).alias("n")).first()
        return row["n"] if row else 0

    def require(self, df: DataFrame, width: int | None = None) -> None:
        """ValueError if a column is missing, or if there are not ``width`` features."""
        names = [self.columns] if self.is_array else self.columns
        missing = [c for c in names if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        if width is not None and not self.is_array and len(self.columns) != width:
            raise ValueError(f"fitted on {width} features, not {len(self.columns)}")

    def checked(self, width: int) -> Column:
        """The array column, with an error in a row of another width."""
        x = F.col(self.columns).cast("array<double>")
        return F.when(F.size(x) == width, x).otherwise(F.raise_error(F.lit(f"the row does not have {width} features")))

    def statistics(self, df: DataFrame, build: dict[str, Callable[[Column], Column]]) -> tuple[int, list[dict[str, float]]]:
        """Row count, and per feature the aggregates, from one pass over the data.

        Of an array column the names tell what is wanted: mean, var, lo, hi.
        """
        self.require(df)
        if not self.is_array:
            columns = [F.col(c).cast("double") for c in self.columns]
            row = df.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{name}_{k}") for k, c in enumerate(columns) for name, f in build.items()]).first()
            return row["n"], [{name: row[f"{name}_{k}"] for name in build} for k in range(len(columns))]
        from ..plans.moments import column_statistics

        parts = column_statistics(df.select(F.col(self.columns).cast("array<double>").alias("x")).where("x is not null"))
        mean = F.sum(F.col("mean") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))
        whole = parts.groupBy("k").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), mean.alias("m"), F.collect_list(F.struct("n", "mean", "m2")).alias("parts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        # Merged about the mean of all, with a row of each partition; nothing cancels.
        spread = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["m2"] + p["n"] * (p["mean"] - F.col("m")) * (p["mean"] - F.col("m")))
        some = F.col("lo") <= F.col("hi")
        rows = whole.select("k", "rows", F.col("m").alias("mean"), (spread / F.nullif(F.col("n") - 1, F.lit(0))).alias("var"), F.when(some, F.col("lo")).alias("lo"), F.when(some, F.col("hi")).alias("hi")).orderBy("k").collect()
        if len({r["rows"] for r in rows}) > 1:
            raise ValueError("rows have different numbers of features")
        return (rows[0]["rows"] if rows else 0), [{name: r[name] for name in build} for r in rows]

    def map(self, df: DataFrame, f: Callable[[Column, Callable[[Sequence[float]], Column]], Column], width: int) -> DataFrame:
        """``df`` with each feature replaced by ``f(value, pick)``; pick(values) is the feature's own of a list."""
        self.require(df, width)
        if not self.is_array:
            return df.withColumns({c: f(F.col(c).cast("double"), lambda values, k=k: F.lit(float(values[k]))) for k, c in enumerate(self.columns)})

        def at(v: Column, i: Column) -> Column:
            return f(v, lambda values: F.get(F.array(*[F.lit(float(x)) for x in values]), i))

        return df.withColumn(self.columns, F.transform(self.checked(width), at))
