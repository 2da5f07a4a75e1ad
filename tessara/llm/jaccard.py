"""N-gram Jaccard self-join by MinHash banding, verified on full n-gram sets.

Documents with equal n-gram sets form a class, and one of each class goes on.
Band hashes put classes into buckets; buckets that share a class form a
candidate group. In each group all pairs of classes are verified on their full
sets, in tiles of bounded size when the group is large. A tile gives a row per
class: its number of links and one edge of a spanning forest, so that nothing
grows with the pairs of a group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, flagged, hashed_words, materialize, mix, slices, windows
from .components import components, roots

ROWS = 6
#: Classes, and n-grams, of a block; a tile holds two blocks.
BLOCK_CLASSES, BLOCK_GRAMS = 256, 1_000_000


def bands_for(threshold: float, recall: float, rows: int = ROWS) -> int:
    """Bands that catch a pair at the threshold with the target recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def gram_sets(raw, offsets, n: int):
    """Distinct n-gram hashes sorted inside each row, and where each row's start.

    A text of fewer than ``n`` words, but not none, has one n-gram of them all.
    """
    h, row, _, _ = hashed_words(raw, offsets, WORD_BYTES)
    grams, at = windows(h, row, n)
    owner = row[at]
    count = np.bincount(row, minlength=len(offsets) - 1)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        begin = np.searchsorted(row, short)
        extra = [windows(h[b : b + count[r]], row[b : b + count[r]], int(count[r]))[0][0] for r, b in zip(short, begin)]
        grams, owner = np.concatenate([grams, np.array(extra, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    if len(grams):
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(offsets)))


def _fingerprints(grams, starts):
    some = starts[:-1] < starts[1:]
    out = np.zeros((2, len(some)), np.uint64)
    if some.any():
        for k, salt in enumerate((0x51ED270B7A, 0x2545F4914F)):
            out[k, some] = np.add.reduceat(mix(grams + np.uint64(salt)), starts[:-1][some])
    return out.view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int, seed: int = 7) -> DataFrame:
    """doc_id, text_key, fp_a, fp_b, n_grams and the band hashes of each document."""
    source = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))

    def run(batches):
        rng = np.random.default_rng(seed)
        factor = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        shift = rng.integers(0, 1 << 63, bands * rows, np.uint64)
        for batch in batches:
            for a, b, raw, offsets in slices(batch.column("text")):
                grams, starts = gram_sets(raw, offsets, n)
                some = np.flatnonzero(starts[:-1] < starts[1:])
                band = np.zeros((b - a, bands), np.uint64)
                if len(some):
                    for k in range(bands):
                        acc = np.full(len(some), k + 1, np.uint64)
                        for r in range(k * rows, (k + 1) * rows):
                            low = np.minimum.reduceat((grams ^ shift[r]) * factor[r], starts[:-1][some])
                            acc = mix(acc + low)
                        band[some, k] = acc
                fp = _fingerprints(grams, starts)
                part = batch.slice(a, b - a)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bands, bands), pa.int32()), pa.array(band.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(fp[0]), pa.array(fp[1]), pa.array(np.diff(starts)), listed], names=["doc_id", "text_key", "fp_a", "fp_b", "n_grams", "bands"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, text_key bigint, fp_a bigint, fp_b bigint, n_grams bigint, bands array<bigint>")


def _bucket_edges(classes: DataFrame) -> DataFrame:
    """Edges (u, v) that join the classes of each bucket.

    Rows are ordered by bucket and class over all partitions, so that a hot
    bucket is spread; neighbours in a bucket are joined, and the first and last
    bucket of each partition is joined with its other parts.
    """
    rows = classes.select(F.explode("bands").alias("b"), F.col("v"))
    rows = rows.repartitionByRange("b", "v").sortWithinPartitions("b", "v")

    def run(batches):
        held = ends = None
        for batch in batches:
            if not batch.num_rows:
                continue
            b, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if held is not None:
                b, v = np.concatenate([[held[0]], b]), np.concatenate([[held[1]], v])
            else:
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array(v[:1]), pa.array(b[:1])], names=["u", "v", "b"])
            same = np.flatnonzero((b[1:] == b[:-1]) & (v[1:] != v[:-1]))
            held = b[-1], v[-1]
            ends = pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array(v[-1:]), pa.array(b[-1:])], names=["u", "v", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(v[same]), pa.array(v[same + 1]), pa.nulls(len(same), pa.int64())], names=["u", "v", "b"])
        if ends is not None:
            yield ends

    found = materialize(rows.mapInArrow(run, "u bigint, v bigint, b bigint"), gather=True)
    # At most two rows of each partition meet here.
    parts = found.where("u is null")
    first = parts.groupBy("b").agg(F.min("v").alias("u"), F.count_distinct("v").alias("n")).where("n > 1")
    return found.where("u is not null").select("u", "v").unionByName(parts.select("b", "v").join(first, "b").select("u", "v"))


def pair_links(sizes, grams, owner, left, right, threshold: float, within: bool):
    """Pairs (i, j) of one tile with Jaccard of at least the threshold, as two index arrays.

    ``grams`` and ``owner`` are all n-grams and the classes they are of.
    ``left`` and ``right`` tell the sides; ``within``: both are the same.
    """
    g = len(sizes)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1], [True]]))
    count = np.diff(edge)
    common = np.zeros((g, g), np.float32)
    few = min(12, g)
    for c in range(2, few + 1):
        begin = edge[:-1][count == c]
        if len(begin):
            m = owner[begin[:, None] + np.arange(c)]
            i, j = np.triu_indices(c, 1)
            flat = (m[:, i] * g + m[:, j]).ravel()
            common += np.bincount(flat, minlength=g * g).reshape(g, g).astype(np.float32)
    many = np.flatnonzero(count > few)
    for a in range(0, len(many), 2048):
        own = many[a : a + 2048]
        dense = np.zeros((g, len(own)), np.float32)
        column = np.repeat(np.arange(len(own)), count[own])
        dense[owner[np.concatenate([np.arange(edge[k], edge[k + 1]) for k in own])], column] = 1
        common += np.triu(dense @ dense.T, 1)
    common = common + common.T
    either = sizes[:, None] + sizes[None, :] - common
    linked = common >= threshold * either - 1e-6
    np.fill_diagonal(linked, False)
    if not within:
        linked &= left[:, None] != left[None, :]
    return np.nonzero(np.triu(linked, 1))


def _verify(rows: DataFrame, threshold: float) -> DataFrame:
    """(v, links, u): for each class of a tile its links, weighted by copies, and a forest edge."""

    def tile(key, parts):
        v = np.array([p[0] for p in parts], np.int64)
        sets = [np.frombuffer(p[3], np.uint64) for p in parts]
        sizes = np.array([len(s) for s in sets], np.float64)
        weight, block = np.array([p[1] for p in parts], np.int64), np.array([p[2] for p in parts], np.int64)
        i, j = pair_links(sizes, np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes.astype(np.int64)), block, block, threshold, key[1] == key[2])
        links = np.bincount(i, weight[j], len(v)) + np.bincount(j, weight[i], len(v))
        order = np.argsort(v, kind="stable")
        rank = np.argsort(order, kind="stable")
        near = np.bincount(i, minlength=len(v)) + np.bincount(j, minlength=len(v))
        root = v[order[roots(len(v), rank[i], rank[j])[rank]]]
        some = near > 0
        return pa.RecordBatch.from_arrays([pa.array(v[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names=["v", "links", "u"])

    def run(batches):
        key, parts = None, []
        for batch in batches:
            columns = [batch.column(c) for c in range(7)]
            keys = list(zip(*(c.to_pylist() for c in columns[:3])))
            values = list(zip(*(c.to_pylist() for c in columns[3:])))
            for k, value in zip(keys, values):
                if k != key:
                    if len(parts) > 1:
                        yield tile(key, parts)
                    key, parts = k, []
                if not parts or parts[-1][0] != value[0]:
                    parts.append(value)
        if len(parts) > 1:
            yield tile(key, parts)

    # The tiles of a group go to partitions one after another, so that none gets several of a large one.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.pmod(F.pmod(F.xxhash64("group"), F.lit(tasks)) + F.col("left").cast("bigint") * F.col("n_blocks") + F.col("right"), F.lit(tasks)).cast("int")
    ordered = rows.repartitionById(tasks, place).drop("n_blocks").sortWithinPartitions("group", "left", "right", "v")
    return ordered.mapInArrow(run, "v bigint, links bigint, u bigint")


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """One row per document: doc_id, text_key, class_id, n_links, n_grams, copy_id, first.

    Links join documents whose sets of ``n`` consecutive words (A-Z in lower
    case; all words of a shorter text) have a Jaccard similarity of at least
    ``threshold``. n_links is the number of other documents linked directly,
    class_id the smallest doc_id that links reach, itself included, copy_id the
    smallest doc_id of those with an equal set, and ``first`` holds for the one
    document of each class that stays (the smallest doc_id, then text_key).

    Texts without words, null ones included, link with nothing. Rows equal in
    doc_id and text are documents of their own. A null doc_id takes part and is
    never the smallest unless all are null.
    """
    bands = bands_for(threshold, recall)
    sig = materialize(signatures(docs, n, bands, ROWS))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    classes = sig.where("n_grams > 0").groupBy(F.col("fp_a").alias("v"), "fp_b").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    classes = materialize(classes.select("v", "at", "copies", "n_grams", "bands"))
    groups = components(_bucket_edges(classes)).withColumnRenamed("root", "group")
    groups = materialize(classes.select("v", "at", "copies", "n_grams").join(groups, "v"))
    shape = groups.groupBy("group").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_CLASSES, F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("n_blocks"))
    members = groups.join(shape, "group").select("v", "copies", "group", "n_blocks", F.pmod(F.xxhash64("v"), "n_blocks").cast("int").alias("block"), F.col("at.doc_id").alias("id"), F.col("at.text_key").alias("k"))
    members = materialize(members)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    texts = flagged(texts.withColumn("__key", F.xxhash64("doc_id", "text_key")), "__key", members.select(F.xxhash64("id", "k").alias("key")), "key").where("__maybe")
    texts = texts.join(members, (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("v", "copies", "group", "n_blocks", "block", "text")

    def sets(batches):
        for batch in batches:
            for a, b, raw, offsets in slices(batch.column("text")):
                grams, starts = gram_sets(raw, offsets, n)
                part = batch.slice(a, b - a)
                blobs = [grams[x:y].tobytes() for x, y in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(blobs, pa.binary())], names=["v", "copies", "group", "n_blocks", "block", "grams"])

    rows = texts.mapInArrow(sets, "v bigint, copies bigint, group bigint, n_blocks int, block int, grams binary")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    rows = rows.select("group", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "v", "copies", "block", "grams", "n_blocks")
    found = materialize(_verify(rows, threshold), gather=True)
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    reached = components(found.select("u", "v"))
    own = classes.join(links, "v", "left").join(reached, "v", "left").select("v", "copies", "at", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "v").alias("root"))
    own = materialize(own)
    best = own.groupBy("root").agg(F.min("at").alias("best"))
    own = own.join(best, "root").select("v", (F.col("links") + F.col("copies") - 1).alias("links"), F.col("at.doc_id").alias("copy_id"), "best")
    out = sig.select("doc_id", "text_key", "n_grams", F.when(F.col("n_grams") > 0, F.col("fp_a")).alias("v")).join(own, "v", "left")
    return out.select(
        "doc_id",
        "text_key",
        F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        "n_grams",
        F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        (F.col("v").isNull() | (F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.text_key") == F.col("text_key")))).alias("first"),
    )


def drop_near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """``docs`` with one document of each class; all columns as they are.

    Rows equal in doc_id and text count as one document; texts without words all stay.
    """
    found = materialize(near_duplicates(docs, n, threshold, recall).where("n_grams > 0").select("doc_id", "text_key", "first"))
    odd = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__k")).agg(F.first("first").alias("__first"), F.count(F.lit(1)).alias("n"))
    odd = materialize(odd.where(~F.col("__first") | (F.col("n") > 1)).select("__id", "__k", "__first"))
    keyed = docs.withColumn("__text_key", F.xxhash64("text")).withColumn("__key", F.xxhash64("doc_id", "__text_key"))
    keyed = flagged(keyed, "__key", odd.select(F.xxhash64("__id", "__k").alias("key")), "key")
    doubted = keyed.where("__maybe").join(odd, (F.col("__text_key") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    once = doubted.where("__first").dropDuplicates(["doc_id", "__text_key"])
    parts = [keyed.where("not __maybe"), doubted.where("__k is null"), once]
    return parts[0].select(*docs.columns).unionByName(parts[1].select(*docs.columns)).unionByName(parts[2].select(*docs.columns))
