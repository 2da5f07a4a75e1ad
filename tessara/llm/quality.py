"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Terms are the words of a text, their shapes (runs of lower-case letters,
capitals and digits become one character each, others stay), and a word said
again at once, two or three times in a row. Words and shapes are taken whole.
Term weights of a bounded sample of labelled documents give a latent space by
eigenvectors of their scatter matrix. Every document's exact cosines with all
sampled vectors are computed in blocks, and its nearest neighbours vote with a
power of their similarity.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice
from operator import and_, eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: Largest number of labelled rows that the model is fitted on, of terms, and of dimensions.
SAMPLE, TERMS, DIMENSIONS = 4000, 1000, 64
NEIGHBOURS, POWER = 15, 16
#: Texts are vectorised and compared in blocks of so many.
BLOCK = 512
#: Words whose terms are remembered, and their longest; others are worked out again.
REMEMBERED, LONGEST = 200_000, 64
_DIGITS = re.compile(r"\d+")
_LOWER = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")


def shape(word: str) -> str:
    """Runs of letters, capitals and digits each as one character, other characters as they are."""
    return _DIGITS.sub("9", _UPPER.sub("A", _LOWER.sub("a", word)))


def repeats(words: list[str]) -> dict[str, float]:
    """Relative frequencies of a word said twice, and three times, in a row."""
    twice = list(map(eq, words, islice(words, 1, None)))
    n, again = len(words), sum(twice)
    out = {"=2": again / n} if again else {}
    thrice = sum(map(and_, twice, islice(twice, 1, None))) if again > 1 else 0
    return out | ({"=3": thrice / n} if thrice else {})


def terms_of(text: str | None) -> dict[str, float]:
    """Relative frequencies of the terms of the whole text."""
    words = (text or "").split()
    if not words:
        return {}
    out: dict[str, float] = {}
    for word, c in Counter(words).items():
        for t in ("s" + shape(word), "w" + word.lower()):
            out[t] = out.get(t, 0.0) + c / len(words)
    return out | repeats(words)


class LatentVoter:
    """Term weights, the latent space, and the labelled vectors in it."""

    def __init__(self, terms: list[str], x: np.ndarray, labels: np.ndarray):
        """``x``: a row of term frequencies per labelled document; it is worked on in place."""
        self.terms = {t: k for k, t in enumerate(terms)}
        self._places: dict[str, tuple[int, ...]] = {}
        self.idf = np.ones(len(terms), np.float32)
        self.labels = labels.astype(np.float32)
        self.prior = float(self.labels.mean()) if len(labels) else 0.5
        if x.size:
            self.idf = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + 1
            scatter = np.zeros((len(terms), len(terms)))
            for a in range(0, len(x), BLOCK):
                x[a : a + BLOCK] = self._weighted(x[a : a + BLOCK])
                part = x[a : a + BLOCK].astype(np.float64)
                scatter += part.T @ part
            _, vectors = np.linalg.eigh(scatter)
            self.space = vectors[:, ::-1][:, :DIMENSIONS].astype(np.float32)
            self.vectors = self._unit(x @ self.space)
        else:
            self.space = np.zeros((len(terms), 0), np.float32)
            self.vectors = np.zeros((len(labels), 0), np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def _weighted(self, x: np.ndarray) -> np.ndarray:
        return self._unit(np.sqrt(x) * self.idf)

    def _row(self, text: str | None) -> np.ndarray:
        """As terms_of(), with the places of known terms remembered by word."""
        words, known, places = (text or "").split(), self.terms, self._places
        row = np.zeros(len(known))
        if words:
            at, weight = [], []
            for word, c in Counter(words).items():
                own = places.get(word)
                if own is None:
                    own = tuple(known[t] for t in ("s" + shape(word), "w" + word.lower()) if t in known)
                    if len(word) <= LONGEST:
                        if len(places) >= REMEMBERED:
                            places.clear()
                        places[word] = own
                for k in own:
                    at.append(k)
                    weight.append(c)
            np.add.at(row, at, weight)
            row /= len(words)
            for t, v in repeats(words).items():
                if t in known:
                    row[known[t]] = v
        return row.astype(np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The share of label 1 in the neighbours' votes; the labels' mean where nothing is similar."""
        x = np.stack([self._row(text) for text in texts]) if len(texts) else np.zeros((0, len(self.terms)), np.float32)
        latent = self._unit(self._weighted(x) @ self.space)
        cosine = latent @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        if not k:
            return np.full(len(texts), self.prior)
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** POWER
        total = weight.sum(1)
        vote = (weight * self.labels[near]).sum(1)
        return np.where(total > 1e-12, vote / np.maximum(total, 1e-12), self.prior)


def training_rows(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, quality) of up to ``sample`` labelled ids outside the held-out fold, in a hash order.

    Null ids and null labels are left out; an id with several labels takes the smallest.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0))
    return usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("__quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_terms: int = TERMS) -> LatentVoter:
    """The model of a bounded sample: at most ``sample`` rows and ``max_terms`` terms reach the driver."""
    ship(docs.sparkSession)
    chosen = training_rows(labels, sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "__quality", "text")

    def vectors(batches):
        for b in batches:
            found = [terms_of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__quality"), pa.array([list(x) for x in found], pa.list_(pa.string())), pa.array([list(x.values()) for x in found], pa.list_(pa.float32()))], names=["id", "y", "terms", "values"])

    schema = T.StructType([T.StructField("id", rows.schema["doc_id"].dataType), T.StructField("y", T.IntegerType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("values", T.ArrayType(T.FloatType()))])
    found = rows.mapInArrow(vectors, schema).persist()
    try:
        least = 3
        top = found.select(F.explode("terms").alias("t")).groupBy("t").count().where(F.col("count") >= least).orderBy(F.desc("count"), "t").limit(max_terms)
        terms = [r[0] for r in top.collect()]
        known = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})

        def indexed(batches):
            for b in batches:
                kept = [[(known.value[t], v) for t, v in zip(ts, vs) if t in known.value] for ts, vs in zip(b.column("terms").to_pylist(), b.column("values").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array([[k for k, _ in x] for x in kept], pa.list_(pa.int32())), pa.array([[v for _, v in x] for x in kept], pa.list_(pa.float32()))], names=["id", "y", "i", "v"])

        out = T.StructType([schema["id"], schema["y"], T.StructField("i", T.ArrayType(T.IntegerType())), T.StructField("v", T.ArrayType(T.FloatType()))])
        # Repeated rows of an id count once, so the sample stays within its bound.
        rows = found.mapInArrow(indexed, out).groupBy("id").agg(F.min(F.struct("y", "i", "v")).alias("r")).orderBy("id").limit(sample)
        got = rows.select("r.y", "r.i", "r.v").toArrow()
    finally:
        found.unpersist()
    index, value = got.column("i").combine_chunks(), got.column("v").combine_chunks()
    x = np.zeros((len(got), len(terms)), np.float32)
    x[np.repeat(np.arange(len(got)), pc.list_value_length(index).to_numpy(zero_copy_only=False)), index.flatten().to_numpy()] = value.flatten().to_numpy()
    return LatentVoter(terms, x, got.column("y").to_numpy())


def score_quality(docs: DataFrame, labels: DataFrame, column: str = "score", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``column``: 0 to 1, higher where label 1 is likelier.

    Only the text is an input of a score. Null, empty and blank texts have no
    terms and take the labels' mean, as all do when there are no labels; equal
    texts have equal scores; a column of that name is replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    kept = [c for c in docs.columns if c != column]
    docs = docs.select(*kept)
    place = kept.index("text")

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                scores = model.value.score(part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*kept, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))
