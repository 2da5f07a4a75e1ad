"""Benchmark decontamination by broadcast n-gram windows."""

from __future__ import annotations

import hashlib
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import LOWER_TABLE, WORD_BYTES, hashed_words, let, materialize, slices, windows

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of the window set up to which it is broadcast.
BROADCAST_BYTES = 64 << 20


def words_of(text: str | None) -> list[str]:
    """The words of a text once A-Z is in lower case."""
    return WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


class WindowSet:
    """Hashes of all benchmark windows, with their words and items for verifying."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.items = sorted({item for item, _ in items})
        number = {item: k for k, item in enumerate(self.items)}
        said = [(number[item], " ".join(words_of(text)).encode()) for item, text in items]
        self.text = b"".join(raw + b" " for _, raw in said)
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        at = 0
        for item, raw in said:
            h, row, first, past = hashed_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), WORD_BYTES)
            length = min(n, len(h))
            if length:
                found, begin = windows(h, row, length)
                parts.setdefault(length, []).append((found, at + first[begin], at + past[begin + length - 1], np.full(len(found), item)))
            at += len(raw) + 1
        # By length: hashes in order, and where a window's words are in the text, and its item's number.
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for length, found in sorted(parts.items()):
            columns = [np.concatenate(c) for c in zip(*found)]
            order = np.argsort(columns[0], kind="stable")
            self.by_length[length] = tuple(c[order] for c in columns)

    def scan(self, raw, offsets):
        """For each row with hits: (row, words hit, items, [(first byte, past byte)]), and words per row."""
        h, row, first, past = hashed_words(raw, offsets, WORD_BYTES)
        hit = np.zeros(len(h) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for length, (known, begin, end, item) in self.by_length.items():
            found, at = windows(h, row, length)
            place = np.searchsorted(known, found)
            place[place == len(known)] = 0
            for k in np.flatnonzero(known[place] == found):
                i, p = int(at[k]), int(place[k])
                said = b" ".join(raw[a:b].tobytes().translate(LOWER_TABLE) for a, b in zip(first[i : i + length], past[i : i + length]))
                while p < len(known) and known[p] == found[k]:  # equal hashes of different words stand side by side
                    if self.text[begin[p] : end[p]] == said:
                        hit[i] += 1
                        hit[i + length] -= 1
                        items.setdefault(int(row[i]), set()).add(self.items[item[p]])
                    p += 1
        covered = np.cumsum(hit[:-1]) > 0
        n_words = np.bincount(row, minlength=len(offsets) - 1)
        out = {}
        for r in items:
            a, b = np.searchsorted(row, [r, r + 1])
            w = np.flatnonzero(covered[a:b]) + a
            runs = np.split(w, np.flatnonzero(np.diff(w) > 1) + 1)
            out[r] = len(w), sorted(items[r]), [(int(first[x[0]] - offsets[r]), int(past[x[-1]] - offsets[r])) for x in runs]
        return n_words, out


def _window_set(benchmark: DataFrame, n: int) -> WindowSet:
    """Null or wordless texts and null item ids have no windows."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text")
    return WindowSet([(r[0], r[1]) for r in rows.distinct().toLocalIterator()], n)


def _size(benchmark: DataFrame) -> int:
    """An upper bound of the window set's bytes: its text, and 32 for each window; a window begins every other byte at most."""
    return 17 * int(benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string")) + 2), F.lit(0))).first()[0])


def _least(share: float) -> tuple[int, int]:
    """The share as an exact fraction of its decimal digits."""
    return Fraction(str(share)).as_integer_ratio()


def scan_documents(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: float = 0.05, key: str = "doc_id") -> DataFrame:
    """Per document: key, n_words, n_hit, items, spans (code points), contaminated.

    A window is ``n`` consecutive words of an item, or all words of a shorter
    one. A document word in any occurrence of a window is hit; a document is
    contaminated if the hit words are at least ``share`` of its words. Null and
    empty texts have no words; repeated rows are scanned each; an empty
    benchmark hits nothing. Only ``key`` and ``text`` are read.

    The windows are broadcast while their size is within BROADCAST_BYTES;
    a larger benchmark is joined by shuffling the windows of both sides.
    """
    if _size(benchmark) > BROADCAST_BYTES:
        return _scan_by_join(docs, benchmark, n, share, key)
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_window_set(benchmark, n))
    source = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            text, out = batch.column("text"), {"n_words": [], "n_hit": [], "items": [], "spans": []}
            for a, b, raw, offsets in slices(text):
                n_words, found = shared.value.scan(raw, offsets)
                for r in range(b - a):
                    hit, items, spans = found.get(r, (0, [], []))
                    if spans:
                        own = raw[offsets[r] : offsets[r + 1]]
                        points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                        spans = [{"start": int(points[x]), "end": int(points[y])} for x, y in spans]
                    for name, value in zip(out, (int(n_words[r]), hit, items, spans)):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_hit"], pa.int64()), pa.array(out["items"], pa.list_(pa.string())), pa.array(out["spans"], kind)], names=["key", *out])

    schema = T.StructType([T.StructField("key", source.schema["key"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    return _judged(source.mapInArrow(run, schema), share).withColumnRenamed("key", key)


def _judged(found: DataFrame, share: float) -> DataFrame:
    part, whole = _least(share)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * F.lit(whole) >= F.col("n_words") * F.lit(part)))


def _scan_by_join(docs: DataFrame, benchmark: DataFrame, n: int, share: float, key: str) -> DataFrame:
    """As scan_documents, for benchmarks beyond the broadcast bound: windows of both sides meet in a shuffle.

    Spans are of whole windows' words; repeated document rows are kept apart by
    a row number taken before the shuffle.
    """
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.coalesce(F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1)), F.array().cast("array<string>"))
    gaps = F.split(lower, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1)
    item = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))

    def runs(length):
        return F.transform(F.sequence(F.lit(0), F.size("w") - length), lambda i: F.array_join(F.slice("w", i + 1, length), " "))

    item = item.select("item", size.alias("len"), F.explode(runs(size)).alias("window")).groupBy("window", "len").agg(F.collect_set("item").alias("items"))
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("key"), words.alias("w"), gaps.alias("g"))
    rows = rows.withColumn("ends", F.expr("slice(aggregate(zip_with(w, slice(g, 1, size(w)), (a, b) -> struct(coalesce(length(b), 0) as b, length(a) as a)), array(named_struct('s', 0, 'e', 0)), (acc, x) -> concat(acc, array(named_struct('s', element_at(acc, -1).e + x.b, 'e', element_at(acc, -1).e + x.b + x.a)))), 2, size(w))"))
    rows = materialize(rows)  # row numbers must not change between the two uses
    lengths = [r[0] for r in item.select("len").distinct().collect()]
    parts = [rows.where(F.size("w") >= k).select("__row", F.lit(k).alias("len"), F.posexplode(runs(F.lit(k))).alias("at", "window")) for k in lengths]
    hits = None
    for part in parts:
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        found = rows.select("key", F.size("w").cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))
        return _judged(found, share).withColumnRenamed("key", key)
    hits = hits.join(item, ["window", "len"]).groupBy("__row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.expr("at + len - 1")))))).alias("at"))
    found = rows.join(hits, "__row", "left")
    merged = F.expr(
        "aggregate(coalesce(at, array()), cast(array() as array<struct<i:int,start:bigint,end:bigint>>), (acc, i) -> if(size(acc) > 0 and element_at(acc, -1).i = i - 1,"
        " concat(slice(acc, 1, size(acc) - 1), array(named_struct('i', i, 'start', element_at(acc, -1).start, 'end', cast(get(ends, i).e as bigint)))),"
        " concat(acc, array(named_struct('i', i, 'start', cast(get(ends, i).s as bigint), 'end', cast(get(ends, i).e as bigint))))))"
    )
    spans = F.transform(merged, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    found = found.select("key", F.size("w").cast("bigint").alias("n_words"), F.coalesce(F.size("at"), F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), spans.alias("spans"))
    found = found.withColumn("n_hit", F.greatest("n_hit", F.lit(0)))
    return _judged(found, share).withColumnRenamed("key", key)


def without_spans(text, spans):
    """The text without spans in order (code points); in UTF-32, where a place is found without counting from the start."""
    edges = F.concat(F.array(F.lit(0).cast("bigint")), F.flatten(F.transform(spans, lambda x: F.array(x["start"], x["end"]))), F.array(F.length(text).cast("bigint")))

    def piece(k, x):
        a, b = F.get(x["e"], 2 * k), F.get(x["e"], 2 * k + 1)
        return F.decode(F.substring(x["w"], (4 * a + 1).cast("int"), (4 * (b - a)).cast("int")), "UTF-32")

    return let(F.struct(F.encode(text, "UTF-32").alias("w"), edges.alias("e")), lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), lambda k: piece(k, x)), ""))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: float = 0.05, action: str = "drop") -> DataFrame:
    """``docs`` without contaminated documents (``drop``), or without the hit spans (``spans``).

    All columns stay as they are but the text of a document that loses spans.
    Null, empty and wordless texts stay; repeated rows are treated alike, each;
    texts are taken whole; an empty benchmark or an empty table changes nothing.
    Beyond BROADCAST_BYTES the documents are written once with a row number, by
    which they meet what the windows found.
    """
    if action not in ("drop", "spans"):
        raise ValueError("action is 'drop' or 'spans'")
    if _size(benchmark) > BROADCAST_BYTES:
        mark = "__row"
        while mark in docs.columns:
            mark += "_"
        keyed = materialize(docs.withColumn(mark, F.monotonically_increasing_id()))
        found = _scan_by_join(keyed, benchmark, n, share, mark)
        if action == "drop":
            return keyed.join(found.where("contaminated").select(mark), mark, "left_anti").select(*docs.columns)
        hit = found.where("n_hit > 0").select(F.col(mark).alias("__hit"), F.col("spans").alias("__spans"))
        left = keyed.join(hit, F.col(mark) == F.col("__hit"), "left")
        return left.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(without_spans(F.col("text").cast("string"), F.col("__spans")))).select(*docs.columns)
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_window_set(benchmark, n))
    part, whole = _least(share)

    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index("text")
            text, keep, cut = batch.column(place), np.ones(batch.num_rows, bool), {}
            for a, _, raw, offsets in slices(text):
                n_words, found = shared.value.scan(raw, offsets)
                for r, (hit, _, spans) in found.items():
                    if action == "drop":
                        keep[a + r] = hit * whole < n_words[r] * part
                    else:
                        own, at, parts = raw[offsets[r] : offsets[r + 1]].tobytes(), 0, []
                        for x, y in spans:
                            parts.append(own[at:x])
                            at = y
                        cut[a + r] = b"".join([*parts, own[at:]]).decode()
            if cut:
                said = text.to_pylist()
                for r, value in cut.items():
                    said[r] = value
                batch = batch.set_column(place, batch.schema.field(place), pa.array(said, text.type))
            yield batch.filter(pa.array(keep)) if action == "drop" else batch

    return docs.mapInArrow(run, docs.schema)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
