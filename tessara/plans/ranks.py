"""Exact row numbers without moving all rows into one partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows aimed at in a bucket of the order, and buckets at least; only buckets' counts are ever brought together.
BUCKET_ROWS, LEAST_BUCKETS = 250_000, 64
#: Parts of the order between approximate quantiles; an outlying key stretches one of them only.
PARTS = 64


def shuffled_key(key: str, seed: int):
    """A pseudo-random, repeatable sort key that other SQL engines can compute too."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def _buckets(n: int) -> int:
    return max(LEAST_BUCKETS, -(-n // BUCKET_ROWS))


def _ordered_bucket(df: DataFrame, key: str):
    """A number that never falls as the key rises: the part between quantiles, and equal widths inside it."""
    k = F.col(key).cast("double")
    shares = [i / PARTS for i in range(PARTS + 1)]
    row = df.agg(F.count(key).alias("n"), F.percentile_approx(k, shares, 10_000).alias("cuts"), F.min(k).alias("lo"), F.max(k).alias("hi")).first()
    if not row["n"]:
        return F.lit(0).cast("bigint")
    cuts = sorted({row["lo"], row["hi"], *row["cuts"]})
    inside = -(-_buckets(row["n"]) // PARTS)
    table = F.array(*[F.lit(c) for c in cuts])
    part = F.greatest(F.lit(0), F.least(F.lit(len(cuts) - 2), F.size(F.filter(table, lambda c: c <= k)) - 1))
    if inside == 1 or len(cuts) < 2:
        return part.cast("bigint")
    low, high = F.get(table, part), F.get(table, part + 1)
    return part.cast("bigint") * inside + F.least(F.lit(inside - 1), F.floor((k - low) / (high - low) * inside)).cast("bigint")


def with_rank(df: DataFrame, key: str, seed: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``rank`` (from 0, in the order of ``key``, or of its hash with a seed) and ``total``.

    With ``by``, both are per group. The order is cut into buckets whose number
    follows the number of rows; a row's rank is its number in its bucket plus
    the rows of the buckets before.
    """
    if seed is None:
        order, bucket = F.col(key), _ordered_bucket(df, key)
    else:
        order = shuffled_key(key, seed)
        bits = (_buckets(df.count()) - 1).bit_length()
        bucket = F.shiftright(F.conv(F.substring(order, 1, 15), 16, 10).cast("bigint"), 60 - bits)
    rows = df.withColumns({"__order": order, "__bucket": bucket})
    counts = rows.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*by)
    before = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(group).alias("total"))
    inside = Window.partitionBy(*by, "__bucket").orderBy("__order", key)
    out = rows.join(counts, [*by, "__bucket"])
    return out.withColumn("rank", F.col("__before") + F.row_number().over(inside) - 1).drop("__order", "__bucket", "__before")
