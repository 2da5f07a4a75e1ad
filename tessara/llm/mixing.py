"""Mixing sources to target weights by Sainte-Lague apportionment.

Everything here is DataFrame operations. The words of each source are cut into
blocks of equal size inside shards of bounded size; blocks are apportioned to
sources, then to the shards of each source, by the highest quotients
``weight / (2 k + 1)``; each shard takes its quota by a seeded order of its
blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, files_for, join_small, materialize

#: A prime above any number of blocks in a shard: a step through blocks that meets each one once.
STEP = 2147483629


def hashed(*columns: Column | str) -> Column:
    """60 bits of an MD5 of the columns, which other SQL engines can compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *columns)), 1, 15), 16, 10).cast("bigint")


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, max_repeat: float) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``).

    Sources take the weights in turn, by code point, null last. Targets are
    ``min(cap, level * weight)``, where the level makes them add up to the
    share of all sizes: that is where resharing the excess by weight ends. With
    sources in order of cap / weight, the level is the largest of (what is left
    once the sources before are full) / (weight of the others).
    """
    every = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.select("*", F.get(given, (F.row_number().over(order) - 1) % len(weights)).alias("weight"))
    s = s.withColumns({"cap": F.col("source_size") * F.lit(float(max_repeat)), "all": F.sum("source_size").over(every) * F.lit(float(share))})
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    full, used = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", (F.col("all") - full) / (F.sum("weight").over(every) - used))
    s = s.withColumn("target", F.least("cap", F.max("level").over(every) * F.col("weight")))
    return s.drop("cap", "all", "level", "weight")


def sainte_lague(rows: DataFrame, group: list[str], key: list[str], weight: str, seats: Column) -> DataFrame:
    """Adds ``quota``: the seats of each row, by the highest quotients in its group.

    A row's exact share differs from its quota by a bounded number of seats,
    so only the quotients around its share are ranked; those before them win
    for certain. The ranked rows grow with the rows, not with the seats.
    """
    g = Window.partitionBy(*group)
    r = rows.withColumns({"__seats": seats, "__all": F.sum(weight).over(g), "__n": F.count(F.lit(1)).over(g)})
    share = F.when(F.col("__all") > 0, F.col("__seats") * F.col(weight) / F.col("__all")).otherwise(F.lit(0.0))
    slack = F.when(F.col("__seats") > 0, F.col("__share") / F.col("__seats") * F.col("__n") / 2 + 2).otherwise(F.lit(0.0))
    r = r.withColumn("__share", share)
    r = r.withColumns({"__low": F.greatest(F.lit(0), F.floor(F.col("__share") - slack)).cast("bigint"), "__high": F.ceil(F.col("__share") + slack).cast("bigint")})
    r = r.withColumn("__left", F.col("__seats") - F.sum("__low").over(g))
    k = r.select(*group, *key, "__left", F.col(weight).alias("__w"), F.explode(F.sequence("__low", "__high")).alias("__k"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy((F.col("__w") / (2 * F.col("__k") + 1)).desc(), *key, "__k"))
    won = k.where(F.col("__w") > 0).withColumn("__place", place).where(F.col("__place") <= F.col("__left"))
    won = won.groupBy(*group, *key).agg(F.count(F.lit(1)).alias("__won"))
    out = r.join(won, [*group, *key], "left").withColumn("quota", F.col("__low") + F.coalesce("__won", F.lit(0)))
    return out.drop("__seats", "__all", "__n", "__share", "__low", "__high", "__left", "__won")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    max_repeat: int = 2,
    block_words: int = 32,
    shard_docs: int = 2048,
    seed: int = 17,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    ``taken`` is the words that the mix takes from the document, repeats
    counted; it never exceeds ``max_repeat * size``. Null texts have size 0 and
    take nothing; a null source is a source of its own, the last; repeated rows
    count each. An empty table gives no rows. Other columns are not read.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = materialize(sized, files=files_for(bytes_of(sized), docs.sparkSession))
    # A key that is never null, so that joins and windows can use it.
    keyed = sized.withColumn("skey", F.concat(F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce("source", F.lit(""))))
    sources = keyed.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = source_targets(sources, weights, share, max_repeat)
    sources = sainte_lague(sources.withColumn("__one", F.lit(1)), ["__one"], ["skey"], "target", F.floor(F.sum("target").over(Window.partitionBy("__one")) / block_words + 0.5).cast("bigint"))
    sources = materialize(sources.select("skey", "source_size", "target", F.col("quota").alias("source_quota"), F.ceil(F.col("n_docs") / shard_docs).cast("int").alias("n_shards")), files=1)  # a row for each source
    rows = join_small(keyed, sources, ["skey"]).withColumn("order", hashed(F.lit(seed), "doc_id", "size"))
    rows = rows.withColumn("shard", F.pmod(F.shiftrightunsigned("order", 7), "n_shards").cast("int"))
    cells = rows.groupBy("skey", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("source_quota"))
    cells = sainte_lague(cells, ["skey"], ["shard"], "words", F.col("source_quota"))
    n_blocks = F.greatest(F.lit(1), F.floor(F.col("words") / block_words + 0.5)).cast("bigint")
    cells = cells.select("skey", "shard", "words", n_blocks.alias("blocks"), "quota")
    cells = cells.withColumns({"quota": F.least("quota", max_repeat * F.col("blocks")), "turn": F.pmod(hashed(F.lit(seed), "skey", "shard"), "blocks")})
    ahead = Window.partitionBy("skey", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(cells, ["skey", "shard"]).withColumn("begin", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    rows = rows.withColumn("end", F.col("begin") + F.col("size"))

    def block_of(place: Column) -> Column:
        return F.floor(((place + 1) * F.col("blocks") - 1) / F.col("words")).cast("bigint")

    def edge(block: Column) -> Column:
        return F.floor(block * F.col("words") / F.col("blocks")).cast("bigint")

    def times(block: Column) -> Column:
        lucky = F.pmod(block * STEP + F.col("turn"), F.col("blocks")) < F.pmod("quota", "blocks")
        return F.floor(F.col("quota") / F.col("blocks")).cast("bigint") + F.when(lucky, 1).otherwise(0)

    def overlap(block: Column) -> Column:
        return F.least(edge(block + 1), F.col("end")) - F.greatest(edge(block), F.col("begin"))

    taken = F.aggregate(F.sequence(block_of(F.col("begin")), block_of(F.col("end") - 1)), F.lit(0).cast("bigint"), lambda acc, b: acc + overlap(b) * times(b))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("bigint").alias("taken"))
