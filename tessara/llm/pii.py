"""Personal data: pattern spans, and terms that disclose them by corpus co-occurrence.

All DataFrame operations. Patterns give the protected entities (e-mail
addresses, IP addresses, card and phone numbers), compared in canonical form:
addresses in lower case, numbers by their digits. Terms near an entity are
held against the corpus: with n_ct joint occurrences, n_c contexts of the
entity, n_t occurrences of the term and N words in all, a term tells
``PMI = log(n_ct N / (n_c n_t))`` of the ``IC = log(N / n_c)`` that the entity
holds. A term discloses the entity when ``PMI >= threshold * IC`` and it stands
with it in two different contexts at least. A context is up to CONTEXT code
points on each side of a match, as far as the next match of its kind; the
joint counts so grow with the matches, not with their pairs. A term that
discloses is marked wherever it stands in a document that holds the entity.

Places are sums over a text's matches in order, taken by windows; no step goes
back to the start of a text for each match, so time is linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, discard, files_for, flagged, join_small, let, materialize

KINDS = ("email", "ip", "card", "phone", "term")
# ``\G`` (where the last match ended) and the look-behind let a match start only where the
# leftmost one can, so that long runs of one class are not tried from each of their characters.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Words of two characters or more that begin with a letter: names of any script, user names with digits.
TERM = r"\p{L}[\p{L}\p{N}_]++"
#: Code points on each side of an entity in which terms are looked at.
CONTEXT = 80


def _matches(text: Column, pattern: str, context: int = 0) -> Column:
    """Leftmost non-overlapping matches in order: array of (gap, m, before, after).

    gap is the number of code points since the match before; before and after
    are up to ``context`` code points between the matches, without a word that the limit cuts.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)

    def row(m, k, pieces):
        before, after = F.get(pieces, k), F.get(pieces, k + 1)
        if not context:
            return F.struct(F.length(before).alias("gap"), m.alias("m"))
        # The right end by its own length, so that a long piece is read once.
        left = F.when(F.length(before) > context, F.regexp_replace(F.right(before, F.lit(context)), r"^[\p{L}\p{N}_]+", "")).otherwise(before)
        right = F.when(F.length(after) > context, F.regexp_replace(F.left(after, F.lit(context)), r"[\p{L}\p{N}_]+$", "")).otherwise(after)
        return F.struct(F.length(before).alias("gap"), m.alias("m"), left.alias("before"), right.alias("after"))

    return let(F.struct(found.alias("f"), pieces.alias("p")), lambda x: F.transform(x["f"], lambda m, k: row(m, k, x["p"])))


def _placed(rows: DataFrame, group: list[str]) -> DataFrame:
    """Matches in rows of their own (``pos``, ``x``) with ``start`` and ``end``, by sums over the group."""
    own = Window.partitionBy(*group).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("x.m")
    rows = rows.withColumn("end", F.sum(F.col("x.gap") + size).over(own).cast("int"))
    return rows.withColumn("start", F.col("end") - size)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(acc, i):
        d = F.substring(turned, i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        def small(p):
            n = F.regexp_replace(p, "^0+", "")
            return (F.length(n) < 3) | ((F.length(n) == 3) & (n <= "255"))

        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        n = F.length(_digits(m))
        return F.when(n.between(13, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _canonical(kind: Column, m: Column) -> Column:
    """What tells an entity from others, however it is written."""
    value = F.when(kind == 0, F.lower(m)).when(kind == 1, F.regexp_replace(m, r"(^|\.)0+(?=[0-9])", "$1")).otherwise(_digits(m))
    return F.concat(kind.cast("string"), F.lit(":"), value)


def _base(docs: DataFrame, context: int, files: int) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, text_key) of each document, and its pattern matches: row, kind, start, end, m, before, after."""
    none = F.expr("cast(array() as array<struct<gap:int,m:string,before:string,after:string>>)")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hits = [F.when(F.rlike(text, F.lit(_HINTS[k])), _matches(text, _PATTERNS[k], context)).otherwise(none) for k in KINDS[:4]]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(text).alias("text_key"), F.array(*hits).alias("hits"))
    rows = materialize(rows, files=files)
    each = rows.where(F.exists("hits", lambda h: F.size(h) > 0)).select("row", F.posexplode("hits").alias("kind", "h")).select("row", "kind", F.posexplode("h").alias("pos", "x"))
    each = _placed(each, ["row", "kind"])
    good = F.lit(False)
    for k, kind in enumerate(KINDS[:4]):
        good = F.when(F.col("kind") == k, _holds(kind, F.col("x.m"))).otherwise(good)
    found = materialize(each.where(good).select("row", "kind", "start", "end", "x.m", "x.before", "x.after"), files=files)
    return rows.select("row", "doc_id", "text_key"), found


def _told(docs: DataFrame, contexts: DataFrame, threshold: float, files: int) -> DataFrame:
    """(entity, term) pairs in which the term discloses the entity."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(TERM), F.lit(0))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    words = materialize(words)
    # Two sides at a time, so that no word runs from one into the other.
    terms = contexts.select("entity", "seen", F.explode(F.array("before", "after")).alias("said")).select("entity", "seen", F.explode(F.regexp_extract_all(F.lower("said"), F.lit(TERM), F.lit(0))).alias("term"))
    joint = terms.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_ct"), F.min("seen").alias("s1"), F.max("seen").alias("s2"))
    joint = joint.where("s1 <> s2").drop("s1", "s2")
    entities = contexts.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"))
    joint = joint.join(entities, "entity").join(words, "term")
    total = words.agg(F.sum("n_t").cast("double").alias("n"))
    joint = joint.crossJoin(F.broadcast(total))  # one row
    gain = F.ln(F.col("n_ct") * F.col("n") / (F.col("n_c") * F.col("n_t")))
    told = materialize(joint.where((F.col("n_c") < F.col("n")) & (gain >= F.lit(threshold) * F.ln(F.col("n") / F.col("n_c")))).select("entity", "term"), files=files)
    discard(words)
    return told


def _marked(docs: DataFrame, rows: DataFrame, found: DataFrame, wanted: DataFrame, files: int) -> DataFrame:
    """(row, extra): places of the wanted (row, term) in the whole texts, but those that overlap a pattern's span."""
    held = wanted.groupBy("row").agg(F.collect_set("term").alias("terms")).join(rows, "row")
    held = materialize(held, files=files)
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).withColumn("k", F.xxhash64("text"))
    texts = flagged(texts, "k", held, "text_key").where("__maybe").drop("__maybe").dropDuplicates(["id", "k"])
    said = texts.join(held, (F.col("k") == F.col("text_key")) & F.col("id").eqNullSafe(F.col("doc_id"))).select("row", "terms", F.posexplode(_matches(F.col("text"), TERM)).alias("pos", "x"))
    said = _placed(said, ["row"]).where(F.array_contains("terms", F.lower("x.m"))).select("row", "start", "end", F.lit(False).alias("base"))
    both = said.unionByName(found.select("row", "start", "end", F.lit(True).alias("base")).join(held.select("row"), "row", "left_semi"))
    by = Window.partitionBy("row").orderBy("start")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(by.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(by.rangeBetween(0, Window.unboundedFollowing))
    free = both.withColumns({"b": before, "a": after}).where(~F.col("base") & (F.coalesce("b", F.lit(0)) <= F.col("start")) & (F.col("a").isNull() | (F.col("a") >= F.col("end"))))
    return free.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.lit(4).alias("kind"), "start", "end"))).alias("extra"))


def find_private(docs: DataFrame, threshold: float = 0.9, context: int = CONTEXT) -> DataFrame:
    """One row per document: doc_id, text_key, base and spans, arrays of (kind, start, end).

    Kinds are numbers into KINDS; spans are sorted by kind, then start, in code
    points, end exclusive. ``base`` has the patterns' spans, ``spans`` terms
    too; those never overlap a pattern's span. Null and empty texts have none;
    repeated rows are searched each and count each; texts are searched whole;
    an empty table gives no rows; other columns are not read. Counts are over
    all documents.
    """
    files = files_for(bytes_of(docs.select("doc_id", "text")), docs.sparkSession)
    rows, found = _base(docs, context, files)
    contexts = found.select("row", _canonical(F.col("kind"), F.col("m")).alias("entity"), F.xxhash64("before", "after").alias("seen"), "before", "after")
    told = _told(docs, contexts, threshold, files)
    wanted = join_small(contexts.select("row", "entity").distinct(), told, ["entity"]).select("row", "term").distinct()
    extra = _marked(docs, rows, found, wanted, files)
    base = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("base"))
    out = rows.join(base, "row", "left").join(extra, "row", "left")
    none = F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")
    return out.select("doc_id", "text_key", F.coalesce("base", none).alias("base"), F.concat(F.coalesce("base", none), F.coalesce("extra", none)).alias("spans"))


def count_kind(spans: Column, k: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("bigint")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, threshold: float = 0.9, generalise: bool = True) -> DataFrame:
    """``docs`` with every span generalised to its kind in angle brackets, or removed.

    Overlapping spans are taken as one, under the kind of the first. Texts
    without spans stay as they are, null ones too; so do other columns; names
    that begin with ``__`` are not for use.
    """
    found = find_private(docs, threshold).where(F.size("spans") > 0).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__k"), "spans").dropDuplicates(["__id", "__k"])
    each = found.select("__id", "__k", F.explode("spans").alias("x")).select("__id", "__k", "x.*")
    own = Window.partitionBy("__k", "__id").orderBy("start", "end", "kind")
    each = each.withColumn("head", F.when(F.col("start") >= F.coalesce(F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), 1).otherwise(0))
    each = each.withColumn("part", F.sum("head").over(own)).groupBy("__id", "__k", "part").agg(F.min(F.struct("start", "end", "kind")).alias("f"), F.max("end").alias("end"))
    merged = each.groupBy("__id", "__k").agg(F.array_sort(F.collect_list(F.struct("f.start", "end", "f.kind"))).alias("__spans"))
    names = F.array(*[F.lit(f"<{k}>" if generalise else "") for k in KINDS])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    wide = F.encode(text, "UTF-32")  # a place in it is found without counting from the start

    def piece(x, k, w):
        at = F.coalesce(F.get(F.col("__spans"), k - 1)["end"], F.lit(0))
        return F.concat(F.decode(F.substring(w, 4 * at + 1, 4 * (x["start"] - at)), "UTF-32"), F.get(names, x["kind"]))

    last = F.element_at("__spans", -1)["end"]
    tail = F.decode(F.substring(wide, 4 * last + 1, 4 * F.length(text)), "UTF-32")
    clean = F.concat(let(wide, lambda w: F.array_join(F.transform("__spans", lambda x, k: piece(x, k, w)), "")), tail)
    keyed = docs.withColumn("__key", F.xxhash64(text))
    out = keyed.join(merged, (F.col("__key") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return out.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(clean)).select(*docs.columns)
