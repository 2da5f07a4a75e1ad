"""Embedding near-dedup: exact cosine links by PCA-ordered tiles.

Vectors are turned into the axes of their second moments, largest first. A
tree of splits along the leading axes, taken from a bounded sample, deals the
vectors into blocks; two blocks meet in a tile only if their boxes come near
enough. A tile adds up products of the leading axes first; the norms of what
is left bound the rest, and pairs that cannot reach the threshold any more are
given up. What remains is decided by the cosine of the vectors as given, in
double precision. The sample only shapes the blocks: every vector is compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .components import components, roots

BLOCK, TREE_SAMPLE, LEADING = 2048, 20_000, 8
#: Axes after which a tile looks at what its pairs can still reach.
STEPS = (8, 24)
#: Rows of a tile that are worked on at a time.
ROWS = 256


def usable(column: str):
    c = F.col(column)
    fine = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(c, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list array without nulls, in doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Eigenvectors of the unit vectors' second moments, largest first, from all vectors."""

    def run(batches):
        total = np.zeros((dims, dims))
        for b in batches:
            if b.num_rows:
                x = unit(_matrix(b.column("x"), dims))
                total += x.T @ x
        i, j = np.indices((dims, dims))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "s"])

    moment = np.zeros((dims, dims))
    for r in vectors.select("x").mapInArrow(run, "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toLocalIterator():
        moment[r["i"], r["j"]] = r["s"]
    _, axes = np.linalg.eigh((moment + moment.T) / 2)
    return np.ascontiguousarray(axes[:, ::-1])


class Splits:
    """A tree of median splits along the leading axes."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple[int, float, int, int]] = []
        self.leaves = 0
        self._grow(sample, max(1, leaves))

    def _grow(self, sample: np.ndarray, leaves: int) -> int:
        spread = sample.var(0) if len(sample) > 1 else np.zeros(1)
        if leaves <= 1 or not spread.max() > 0:
            self.leaves += 1
            return -self.leaves
        axis = int(np.argmax(spread))
        cut = float(np.quantile(sample[:, axis], (leaves // 2) / leaves))
        low = sample[:, axis] < cut
        if not low.any() or low.all():
            self.leaves += 1
            return -self.leaves
        at = len(self.nodes)
        self.nodes.append((axis, cut, 0, 0))
        below = self._grow(sample[low], leaves // 2)
        above = self._grow(sample[~low], leaves - leaves // 2)
        self.nodes[at] = (axis, cut, below, above)
        return at

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(0 if self.nodes else -1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            axis, cut, below, above = self.nodes[node]
            low = x[rows, axis] < cut
            todo += [(below, rows[low]), (above, rows[~low])]
        return out


def tile_links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool):
    """Pairs (i, j) of rows of ``a`` and ``b`` with cosine >= threshold; i < j if both are the same."""
    ua, ub = unit(a), unit(b)
    ta, tb = ua @ axes, ub @ axes
    stops = [s for s in STEPS if s < ta.shape[1]]
    left_a = [np.sqrt(np.maximum((ta[:, s:] ** 2).sum(1), 0)) for s in stops]
    left_b = [np.sqrt(np.maximum((tb[:, s:] ** 2).sum(1), 0)) for s in stops]
    found = []
    for r in range(0, len(a), ROWS):
        rows = slice(r, r + ROWS)
        begin, sums, live = 0, 0.0, None
        for k, s in enumerate(stops):
            sums = sums + ta[rows, begin:s] @ tb[:, begin:s].T
            live = sums + left_a[k][rows, None] * left_b[k][None, :] >= threshold - 1e-9
            begin = s
            if np.count_nonzero(live) * 50 < live.size:  # few are left: they are finished one by one
                break
        if live is None:
            i, j = np.indices((len(ua[rows]), len(ub))).reshape(2, -1)
        else:
            i, j = np.nonzero(live)
        if same:
            keep = i + r < j
            i, j = i[keep], j[keep]
        if live is not None and len(i) * 50 >= live.size:
            cosine = (ua[rows] @ ub.T)[i, j]
            near = cosine >= threshold - 1e-9
            i, j = i[near], j[near]
        for c in range(0, len(i), 65536):
            x, y = i[c : c + 65536], j[c : c + 65536]
            good = np.einsum("ij,ij->i", ua[x + r], ub[y]) >= threshold
            found.append((x[good] + r, y[good]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _blocks(vectors: DataFrame, dims: int, axes: np.ndarray, kind: type) -> DataFrame:
    """One row per block: block, ids, copies and vectors packed, and its box along the leading axes."""
    lead = min(LEADING, dims)
    n = vectors.count()
    sample = vectors.orderBy(F.xxhash64("v"), "v").limit(TREE_SAMPLE).select("x")
    turned = np.array([r[0] for r in sample.collect()], np.float64).reshape(-1, dims)
    splits = Splits((unit(turned) @ axes)[:, :lead], -(-n // BLOCK))

    def deal(batches):
        for b in batches:
            if b.num_rows:
                x = unit(_matrix(b.column("x"), dims)) @ axes[:, :lead]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(splits.leaf(x))], names=[*b.schema.names, "leaf"])

    dealt = materialize(vectors.mapInArrow(deal, T.StructType([*vectors.schema.fields, T.StructField("leaf", T.LongType())])))
    # At most TREE_SAMPLE leaves: a small table by construction.
    parts = dealt.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n_parts"))
    dealt = dealt.join(F.broadcast(parts), "leaf")
    dealt = dealt.withColumn("block", F.col("leaf") * (1 << 32) + F.pmod(F.xxhash64("v"), "n_parts"))

    def packed(key, held):
        x = np.concatenate([h[2] for h in held])
        box = unit(x.astype(np.float64)) @ axes[:, :lead]
        blobs = [np.concatenate([h[0] for h in held]).tobytes(), np.concatenate([h[1] for h in held]).tobytes(), x.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([key]), *(pa.array([v], pa.binary()) for v in blobs), pa.array([list(box.min(0))]), pa.array([list(box.max(0))])], names=["block", "ids", "copies", "x", "lo", "hi"])

    def pack(batches):
        key, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            block = b.column("block").to_numpy()
            v, copies, x = b.column("v").to_numpy(), b.column("copies").to_numpy(), _matrix(b.column("x"), dims).astype(kind)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
            for s, e in zip(edges, edges[1:]):
                if block[s] != key:
                    if held:
                        yield packed(key, held)
                    key, held = int(block[s]), []
                held.append((v[s:e], copies[s:e], x[s:e]))
        if held:
            yield packed(key, held)

    ordered = dealt.select("block", "v", "copies", "x").repartition("block").sortWithinPartitions("block", "v")
    return materialize(ordered.mapInArrow(pack, "block bigint, ids binary, copies binary, x binary, lo array<double>, hi array<double>"))


def _tiles(blocks: DataFrame, threshold: float) -> DataFrame:
    """Pairs of blocks whose boxes come within the distance of the threshold.

    Boxes are put on a grid over the first two axes; blocks that share a cell
    of it, one of them widened by the distance, are held against each other.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    width = max(reach, 0.05)

    def cells(axis: int, more: float):
        return F.sequence(F.floor((F.get("lo", F.lit(axis)) - more) / width), F.floor((F.get("hi", F.lit(axis)) + more) / width))

    def on_grid(side: str, more: float):
        g = blocks.select("block", "lo", "hi", F.explode(cells(0, more)).alias("c0"))
        second = F.when(F.size("lo") > 1, cells(1, more)).otherwise(F.array(F.lit(0).cast("bigint")))
        return g.select("c0", F.explode(second).alias("c1"), F.col("block").alias(side), F.col("lo").alias(f"lo_{side}"), F.col("hi").alias(f"hi_{side}"))

    pairs = on_grid("a", 0.0).join(on_grid("b", reach), ["c0", "c1"]).where("a <= b").drop("c0", "c1").dropDuplicates(["a", "b"])
    gap = F.zip_with(F.arrays_zip(F.col("lo_a").alias("l"), F.col("hi_a").alias("h")), F.arrays_zip(F.col("lo_b").alias("l"), F.col("hi_b").alias("h")), lambda p, q: F.greatest(p["l"] - q["h"], q["l"] - p["h"], F.lit(0.0)))
    apart = F.aggregate(gap, F.lit(0.0), lambda acc, g: acc + g * g)
    return pairs.where(apart <= reach * reach).select("a", "b")


def _links(blocks: DataFrame, tiles: DataFrame, dims: int, axes: np.ndarray, kind: type, threshold: float) -> DataFrame:
    one, two = (blocks.select(F.col("block").alias(s), F.col("ids").alias(f"ids_{s}"), F.col("copies").alias(f"copies_{s}"), F.col("x").alias(f"x_{s}")) for s in "ab")
    # Sides are swapped in half of the tiles, so that no block is on one side of many.
    t = tiles.withColumn("odd", F.pmod(F.xxhash64("a", "b"), F.lit(2)) == 1)
    t = t.select(F.when(F.col("odd"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("odd"), F.col("a")).otherwise(F.col("b")).alias("b"))
    rows = t.join(one, "a").join(two, "b")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in ("a", "b", "ids_a", "copies_a", "x_a", "ids_b", "copies_b", "x_b")}
                same = row["a"] == row["b"]
                (va, ca, xa), (vb, cb, xb) = ((np.frombuffer(row[f"ids_{s}"], np.int64), np.frombuffer(row[f"copies_{s}"], np.int64), np.frombuffer(row[f"x_{s}"], kind).reshape(-1, dims).astype(np.float64)) for s in "ab")
                i, j = tile_links(xa, xb, axes, threshold, same)
                if not len(i):
                    continue
                v, weight = (va, ca) if same else (np.concatenate([va, vb]), np.concatenate([ca, cb]))
                j = j if same else j + len(va)
                links = np.bincount(i, weight[j], len(v)) + np.bincount(j, weight[i], len(v))
                some = np.flatnonzero(links > 0)
                root = roots(len(v), i, j)[some]
                yield pa.RecordBatch.from_arrays([pa.array(v[some]), pa.array(links[some].astype(np.int64)), pa.array(v[root])], names=["v", "links", "u"])

    return rows.mapInArrow(run, "v bigint, links bigint, u bigint")


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per vector: key, n_links, component_id, kept.

    n_links is the number of other vectors with a cosine of at least
    ``threshold``, component_id the smallest key that links reach, itself
    included, and ``kept`` tells that the key is its component's. Vectors that
    are null, empty or zero, or hold null or non-finite components, link with
    nothing; so do vectors of different lengths. Equal vectors are linked, and
    one of them is compared for all. Rows with equal keys are vectors of their
    own; a null key takes part, and is its own component's only if all are
    null. Other columns are not read.
    """
    element = vectors.schema[column].dataType.elementType
    kind = np.float32 if isinstance(element, T.FloatType) else np.float64
    rows = vectors.select(F.col(key).alias("id"), F.col(column).alias("x"), usable(column).alias("ok"))
    rows = rows.withColumn("x", F.when(F.col("ok"), F.transform("x", lambda c: c + F.lit(0).cast(element))))  # no negative zeros
    rows = rows.select("id", F.when(F.col("ok"), F.xxhash64("x")).alias("v"), "x")
    good = rows.where("v is not null")
    classes = good.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("x").alias("x"))
    classes = materialize(classes)
    found = None
    for r in classes.select(F.size("x").alias("d")).distinct().collect():
        dims = int(r["d"])
        own = classes.where(F.size("x") == dims).select("v", "copies", "x")
        axes = principal_axes(own, dims)
        blocks = _blocks(own, dims, axes, kind)
        part = _links(blocks, materialize(_tiles(blocks, threshold)), dims, axes, kind, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialize(found, gather=True)
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    reached = components(found.select("u", "v"))
    own = classes.select("v", "id", "copies").join(links, "v", "left").join(reached, "v", "left").select("v", "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "v").alias("root"))
    own = materialize(own)
    best = own.groupBy("root").agg(F.min("id").alias("component_id"))
    own = own.join(best, "root").select("v", "n_links", "component_id")
    out = rows.select("id", "v").join(own, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
