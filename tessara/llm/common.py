"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Bytes of text that the vectorised tokeniser takes at a time.
SLICE_BYTES = 1 << 20
#: Rows up to which a small table may be broadcast.
BROADCAST_ROWS = 100_000
#: Rows, of 64 bits each, of the table that flagged() broadcasts.
BITMAP_WORDS = 1 << 20

_M = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only in local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessara-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Estimated bytes that a file of an intermediate table takes, when its number of files is chosen.
FILE_BYTES = 16 << 20
_written: dict[str, SparkSession] = {}


#: Estimates from here on say that the size is not known.
UNKNOWN = 1 << 56


def bytes_of(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def files_for(n_bytes: int, spark: SparkSession) -> int:
    """A number of files that follows the size; a task for each core at least. An unknown size counts as very large."""
    return max(spark.sparkContext.defaultParallelism, min(1 << 24, -(-n_bytes // FILE_BYTES)))


def materialize(df: DataFrame, gather: bool = False, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    ``gather`` is for small results of many tasks: they are dealt anew to
    partitions of Spark's advisory size first, so as not to leave a file each.
    ``files`` bounds the files without a shuffle: neighbouring partitions are
    written by one task, one after another.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/tessara-{uuid.uuid4().hex}"
    out = df.hint("rebalance") if gather else df
    (out.coalesce(files) if files else out).write.parquet(path)
    if not _written:
        atexit.register(release, [])
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def tables() -> list[str]:
    """Paths of the intermediate tables that are still there."""
    return list(_written)


def release(keep: list[str]) -> None:
    """Remove the intermediate tables but those at the paths of ``keep``; none of the others may be read again."""
    for path in [p for p in _written if p not in keep]:
        _remove(_written.pop(path), path)


def discard(df: DataFrame) -> None:
    """Remove the table that materialize() made for ``df``, which nothing may read any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for path in [p for p in _written if name.endswith(p) or p.endswith(name)]:
            _remove(_written.pop(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def join_small(left: DataFrame, small: DataFrame, on: list[str], salts: int = 64) -> DataFrame:
    """Inner join with a table that is small as a rule.

    ``small`` is counted first: it is broadcast when it has at most
    BROADCAST_ROWS rows; otherwise it is repeated over ``salts`` salts, so that
    a hot key of ``left`` is spread over as many partitions.
    """
    if small.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(small), on)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hashed = [c for c, kind in left.dtypes if "variant" not in kind and "map<" not in kind]
    return left.withColumn("__salt", F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int")).join(salted, [*on, "__salt"]).drop("__salt")


def flagged(df: DataFrame, key: str, members: DataFrame, member_key: str) -> DataFrame:
    """``df`` with ``__maybe``: false only where its ``key`` is none of the members'.

    The members' 64-bit keys set bits of a table of BITMAP_WORDS rows, which
    is all that is broadcast, however many members there are. Rows that are
    surely no members so keep out of a shuffle.
    """
    def word(k):
        return F.pmod(F.col(k), F.lit(BITMAP_WORDS))

    def bit(k):
        return F.expr(f"shiftleft(1L, cast(pmod(shiftright({k}, 30), 64) as int))")

    words = members.select(word(member_key).alias("__word"), bit(member_key).alias("b")).groupBy("__word").agg(F.bit_or("b").alias("__bits"))
    out = df.withColumn("__word", word(key)).join(F.broadcast(words), "__word", "left")
    return out.withColumn("__maybe", F.coalesce(F.col("__bits").bitwiseAND(bit(key)) != 0, F.lit(False))).drop("__word", "__bits")


def let(value, body):
    """``body(value)`` with the value computed once, not again at each of its uses inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def byte_class(wanted) -> np.ndarray:
    return np.array([bool(wanted(b)) for b in range(256)])


#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is in lower case.
WORD_BYTES = byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
#: Bytes of ``[^\x20\x09-\x0D]+``.
TOKEN_BYTES = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
LINE_BYTES = byte_class(lambda b: b != 0x0A)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
LOWER_TABLE = bytes(LOWER)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and where each value starts and ends; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, last row, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    raw, offsets = text_bytes(column)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def hashed_words(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The 64-bit hash of each word, its row, and its first and past-the-end byte.

    A word is a maximal run of bytes of ``kind`` inside one row. Hashes are
    those of a polynomial over the bytes, from prefix sums modulo 2**64; they
    are made for about SLICE_BYTES at a time.
    """
    if len(raw) <= SLICE_BYTES:
        return _hashed(raw, offsets, kind, lower)
    parts, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1)
        begin = offsets[a]
        h, row, first, past = _hashed(raw[begin : offsets[b]], offsets[a : b + 1] - begin, kind, lower)
        parts.append((h, row + a, first + begin, past + begin))
        a = b
    return tuple(np.concatenate(x) for x in zip(*parts))


def _hashed(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if not len(raw):
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    data = LOWER[raw] if lower else raw
    inside = kind[data]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    starts[edges] = inside[edges]
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = inside[last]
    first, past = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _grown(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.add(data, np.uint64(1), out=sums[1:], dtype=np.uint64, casting="unsafe")
    sums[1:] *= power[: len(data)]
    np.cumsum(sums, out=sums)
    h = (sums[past] - sums[first]) * inverse[first]
    h = mix(h + (past - first).astype(np.uint64) * _M)
    return h, np.searchsorted(offsets, first, "right") - 1, first, past


def windows(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside one row, and the first word's place."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = (out + h[at + k]) * np.uint64(_BASE)
        out ^= out >> np.uint64(29)
    return mix(out + np.uint64(n)), at
