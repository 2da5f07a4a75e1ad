"""Line dedup: repeated runs of lines from a suffix array by distributed prefix doubling.

A line is known by 128 bits of its hash. A line that occurs once ends every
repeated run, so documents fall into pieces: runs of lines that each occur
elsewhere too. Pieces of fewer than ``min_words`` words hold no run that counts,
and of equal pieces only the first is looked into, as the others are later
copies from end to end. So neither unique text nor large groups of copies reach
the suffix array.

The suffixes of the pieces that are left are sorted by prefix doubling: their
dense rank by ``2 * k`` lines comes from sorting pairs of ranks by ``k`` lines,
there and ``k`` lines further on. A suffix whose rank is its own leaves, as it
shares no longer prefix with any other. Places that stay with equal ranks are the
intervals of the suffix array whose longest common prefix has that many lines
at least; the interval of ``w`` lines, ``k <= w < 2 * k``, has equal ranks at its
place and at ``w - k`` lines further on. All but the first place of an interval
are later copies.

Runs are taken from the intervals of the shortest prefixes of at least
``min_words`` words that start with a line, and of those that end with one: a
maximal repeated run is their union, whatever its length, so no deeper rank can
add to what is deleted, and doubling ends at ``min_words`` lines.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, discard, files_for, flagged, materialize

SPACE = r"[\x09-\x0D]"


def _lines(docs: DataFrame) -> DataFrame:
    """One row per non-blank line: document, number among its non-blank lines, line number, words, name."""
    said = F.transform(F.split(F.col("text").cast("string"), "\n", -1), lambda t, i: F.struct(i.alias("line"), F.trim(F.regexp_replace(t, SPACE, " ")).alias("t")))
    lines = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("key"), F.posexplode(F.filter(said, lambda x: x["t"] != "")).alias("i", "x"))
    words = F.size(F.split(F.col("x.t"), " +"))
    return lines.select("doc", "key", "i", F.col("x.line").alias("line"), words.alias("words"), F.xxhash64(F.lit(1), "x.t").alias("a"), F.xxhash64(F.lit(2), "x.t").alias("b"))


def _pieces(docs: DataFrame, min_words: int, files: int) -> DataFrame:
    """One row per piece: document, its lines and words, names packed, and their fingerprint."""
    lines = materialize(_lines(docs))
    place = F.xxhash64("doc", "key", "i")
    # Rows equal in doc_id and text are one document, so a place may occur twice.
    names = lines.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    names = materialize(names.where("first <> last").select("a", "b"), files=files)
    maybe = flagged(lines, "a", names, "a").where("__maybe").drop("__maybe")
    repeated = maybe.join(names.hint("merge"), ["a", "b"], "left_semi").dropDuplicates(["key", "doc", "i"])
    own = Window.partitionBy("key", "doc").orderBy("i")
    begins = F.when(F.col("i") - F.lag("i").over(own) == 1, 0).otherwise(1)
    repeated = repeated.withColumn("begins", begins).withColumn("piece", F.sum("begins").over(own))
    held = repeated.groupBy("key", "doc", "piece").agg(F.sum("words").alias("total"), F.array_sort(F.collect_list(F.struct("i", "line", "words", "a", "b"))).alias("x")).where(F.col("total") >= min_words)
    held = held.select("doc", "key", F.get("x.i", F.lit(0)).alias("i"), F.col("x.line").alias("lines"), F.col("x.words").alias("words"), F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    out = materialize(held.withColumns({"f": F.xxhash64(F.lit(3), "a", "b"), "g": F.xxhash64(F.lit(4), "b", "a")}), files=files)
    discard(lines)
    discard(names)
    return out


def _in_order(rows: DataFrame, by: list[str], also: list[str], files: int) -> tuple[DataFrame, list[dict]]:
    """Rows sorted over all partitions, with what a partition alone can tell, and a summary of each partition.

    Adds ``part`` (the partition's label), ``at`` (the row's number in it),
    ``run`` (the number of its run of rows equal in ``also``) and ``alone``. The
    summaries are in order; their number is that of the partitions.
    """
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    names = ordered.columns
    keys = [names.index(c) for c in also]

    def run(batches):
        label = uuid.uuid4().int >> 65
        at = run_ = -1
        held = last = None

        def out(batch, until):
            nonlocal at, run_, last
            n = batch.num_rows
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.ones(n + 1, bool)
            if keys:
                new[1:n] = np.any([c[1:] != c[:-1] for c in columns], axis=0) if n > 1 else False
                new[0] = last is None or any(c[0] != x for c, x in zip(columns, last))
            number = run_ + np.cumsum(new[:until])
            fresh = [pa.array(np.full(until, label)), pa.array(at + 1 + np.arange(until)), pa.array(number), pa.array(new[:until] & new[1 : until + 1])]
            if until:
                at, run_, last = at + until, int(number[-1]), [c[until - 1] for c in columns]
            return pa.RecordBatch.from_arrays([*batch.slice(0, until).columns, *fresh], names=[*names, "part", "at", "run", "alone"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:  # the last row waits for what follows it
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            yield out(batch, batch.num_rows - 1)
            held = batch.slice(batch.num_rows - 1)
        if held is not None:
            yield out(held, 1)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields)
    found = materialize(ordered.mapInArrow(run, f"{kinds}, part bigint, at bigint, run bigint, alone boolean"), files=files)
    ends = F.struct("at", "run", *also)
    parts = found.groupBy("part").agg(F.min(F.struct(*by)).alias("place"), F.min(ends).alias("first"), F.max(ends).alias("last")).orderBy("place").drop("place").collect()
    return found, [r.asDict(recursive=True) for r in parts]


def _numbered(found: DataFrame, parts: list[dict], also: list[str]) -> DataFrame:
    """Adds ``number`` and dense ``rank`` over all partitions, and ``single``: no other row has its rank."""
    rows, number, rank, before = [], 0, -1, None
    for k, p in enumerate(parts):
        first, last = [p["first"][c] for c in also], [p["last"][c] for c in also]
        goes_on = bool(also) and first == before
        follows = parts[k + 1]["first"] if k + 1 < len(parts) else None
        rank += 0 if goes_on else 1
        rows.append((p["part"], number, rank, goes_on, bool(also) and follows is not None and last == [follows[c] for c in also], p["last"]["run"]))
        number, rank, before = number + p["last"]["at"] + 1, rank + p["last"]["run"], last
    edges = found.sparkSession.createDataFrame(rows, "part bigint, __number bigint, __rank bigint, __on boolean, __more boolean, __runs bigint")
    out = found.join(F.broadcast(edges), "part")  # a row for each partition
    single = F.col("alone") & ~((F.col("run") == 0) & F.col("__on")) & ~((F.col("run") == F.col("__runs")) & F.col("__more"))
    out = out.withColumns({"number": F.col("__number") + F.col("at"), "rank": F.col("__rank") + F.col("run"), "single": single})
    return out.drop("part", "at", "run", "alone", *edges.columns)


def _suffixes(pieces: DataFrame, min_words: int) -> DataFrame:
    """One row per line of a piece: place, its number in the piece and the lines left, name, and its windows.

    Windows of ``m`` to ``most`` lines are those that are the shortest of at least
    ``min_words`` words from their first line (``m``) or up to their last (the
    longer ones, one for each line that ends one); ``m`` is 0 for none.
    """

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                start = batch.column("start")[k].as_py()
                words, a, b = (batch.column(c)[k].values for c in ("words", "a", "b"))
                past = np.cumsum(words.to_numpy(zero_copy_only=False).astype(np.int64))
                n, before = len(past), np.concatenate([[0], past[:-1]])
                i = np.arange(n)
                m = np.searchsorted(past, before + min_words) - i + 1
                m[i + m > n] = 0
                # A window is the shortest up to its last line when fewer than min_words words follow its first line.
                most = np.minimum(np.searchsorted(past, past + min_words), n) - i
                yield pa.RecordBatch.from_arrays([pa.array(start + i), pa.array(i.astype(np.int32)), pa.array((n - i).astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(np.maximum(m, most).astype(np.int32)), a, b], names=["place", "nth", "left", "m", "most", "a", "b"])

    return pieces.select("start", "words", "a", "b").mapInArrow(run, "place bigint, nth int, left int, m int, most int, a bigint, b bigint")


def suffix_ranks(rows: DataFrame, a: str, b: str, files: int) -> DataFrame:
    """Dense ranks of the pairs (a, b) of each place, for the places that share theirs."""
    found, parts = _in_order(rows, [a, b, "place"], [a, b], files)
    return _numbered(found, parts, [a, b]).where("not single").select("place", "nth", "left", "m", "most", "rank")


def _further(rows: DataFrame, ranks: DataFrame, at: Column) -> DataFrame:
    """Adds the rank at a later place, where it is shared."""
    return rows.withColumn("__at", at).join(ranks.select(F.col("place").alias("__at"), F.col("rank").alias("rank_2")), "__at").drop("__at")


def _copied(pieces: DataFrame, min_words: int, files: int) -> DataFrame:
    """(start, nth, w): the w lines from the nth of the piece at ``start`` are a later copy."""
    ranks = suffix_ranks(_suffixes(pieces, min_words), "a", "b", files)
    intervals, size = [], 1
    while True:
        rows = ranks.where((F.col("m") > 0) & (F.col("most") >= size) & (F.col("m") < 2 * size))
        rows = rows.withColumn("w", F.explode(F.sequence(F.greatest("m", F.lit(size)), F.least("most", F.lit(2 * size - 1)))))
        rows = _further(rows.where("w <= left"), ranks, F.col("place") + F.col("w") - size)
        intervals.append(rows.select("place", "nth", "w", "rank", "rank_2"))
        if 2 * size > min_words:
            break
        longer = _further(ranks.where(F.col("left") >= 2 * size), ranks, F.col("place") + size)
        ranks = suffix_ranks(longer, "rank", "rank_2", files)
        size *= 2
    found = intervals[0]
    for more in intervals[1:]:
        found = found.unionByName(more)
    found = materialize(found, files=files)
    first = found.groupBy("w", "rank", "rank_2").agg(F.min("place").alias("place"))
    later = found.join(first.select("place", "w"), ["place", "w"], "left_anti")
    return later.select((F.col("place") - F.col("nth")).alias("start"), "nth", "w")


def later_copies(docs: DataFrame, min_words: int = 51) -> DataFrame:
    """Later copies of repeated runs: doc, key, and ``cut``, an array of (first, last) line numbers, ends included.

    Copies are ordered by doc_id (null first), then text hash, then line.
    """
    files = files_for(bytes_of(docs.select("doc_id", "text")), docs.sparkSession)
    pieces = _pieces(docs, min_words, files)
    place = F.struct("doc", "key", "i")
    whole = pieces.groupBy("f", "g").agg(F.min(place).alias("first"))
    whole = materialize(whole.select("first.*"), files=files)
    on = (F.col("p.key") == F.col("w.key")) & F.col("p.doc").eqNullSafe(F.col("w.doc")) & (F.col("p.i") == F.col("w.i"))
    first = pieces.alias("p").join(whole.alias("w"), on, "left_semi")
    copies = pieces.alias("p").join(whole.alias("w"), on, "left_anti")
    found, parts = _in_order(first.withColumn("n", F.size("lines")), ["doc", "key", "i"], [], files)
    # Places are numbered by piece, then line; a piece leaves room for lines of any text.
    first = _numbered(found, parts, []).withColumn("start", F.col("number") * (1 << 31)).drop("number", "rank", "single")
    cut = _copied(first, min_words, files).groupBy("start").agg(F.collect_list(F.struct("nth", "w")).alias("cut"))
    cut = first.join(cut, "start").select("doc", "key", F.transform("cut", lambda c: F.struct(F.get("lines", c["nth"]).alias("first"), F.get("lines", c["nth"] + c["w"] - 1).alias("last"))).alias("cut"))
    ends = F.struct(F.get("lines", F.lit(0)).alias("first"), F.get("lines", F.size("lines") - 1).alias("last"))
    cut = cut.unionByName(copies.select("doc", "key", F.array(ends).alias("cut")))
    return cut.groupBy("doc", "key").agg(F.array_sort(F.flatten(F.collect_list("cut"))).alias("cut"))


def without_ranges(lines: list[str], ranges: list[tuple[int, int]]) -> list[str]:
    """Lines outside all of the ranges, which are sorted and may overlap."""
    out, at = [], 0
    for first, last in ranges:
        if first > at:
            out += lines[at:first]
        at = max(at, last + 1)
    return out + lines[at:]


def dedup_lines(docs: DataFrame, min_words: int = 51) -> DataFrame:
    """``docs`` without later copies of line runs, and with n_lines, n_deleted.

    A run of lines of at least ``min_words`` words in all that occurs before,
    in this or another document, is deleted, with blank lines inside it. Lines
    are compared without white space at their ends; the others stay byte for
    byte. Null texts stay null with 0 lines, and empty ones have one line; rows
    equal in doc_id and text are one document and are treated alike; a null
    doc_id comes first; an empty table gives no rows. A run that overlaps its
    own copy keeps the part before the overlap. Texts are taken whole, in time
    linear in their lines. Columns n_lines and n_deleted are replaced; names
    that begin with ``__`` are not for use.
    """
    cut = materialize(later_copies(docs, min_words).select(F.col("doc").alias("__doc"), F.col("key").alias("__key"), "cut").withColumnRenamed("cut", "__cut"), files=files_for(bytes_of(docs.select("doc_id", "text")), docs.sparkSession))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split(F.col("text").cast("string"), "\n", -1))).cast("bigint")
    keyed = docs.select(*kept, n_lines.alias("n_lines"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("__k"))
    keyed = flagged(keyed, "__k", cut, "__key")
    plain = F.lit(0).cast("bigint").alias("n_deleted")
    # Merged at every size: what is broadcast would grow with the input.
    doubted = keyed.where("__maybe").join(cut.hint("merge"), (F.col("__k") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__doc")), "left")
    hit = doubted.where("__cut is not null").select(*kept, "n_lines", "__cut")
    place = kept.index("text")

    def run(batches):
        for batch in batches:
            texts, gone = [], []
            for text, ranges in zip(batch.column(place).to_pylist(), batch.column("__cut").to_pylist()):
                lines = text.split("\n")
                left = without_ranges(lines, [(r["first"], r["last"]) for r in ranges])
                texts.append("\n".join(left))
                gone.append(len(lines) - len(left))
            columns = batch.columns[:-1]
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int64())], names=[*kept, "n_lines", "n_deleted"])

    clean = hit.drop("__cut").select("*", plain).schema
    out = hit.mapInArrow(run, clean)
    untouched = keyed.where("not __maybe").select(*kept, "n_lines", plain).unionByName(doubted.where("__cut is null").select(*kept, "n_lines", plain))
    return untouched.unionByName(out)
