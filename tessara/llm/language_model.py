"""Language-model scoring with an Elias-Fano n-gram trie, sharded over the cluster.

Texts are packed into chunks. Each chunk asks for its distinct words and word
pairs, with their counts in its training documents; so a word or pair that all
documents hold travels once per chunk. A shard adds up the counts of its keys
over all chunks, builds a trie of them in memory-mapped levels, and answers
every chunk's keys from it. A chunk then adds up its documents' probabilities.
No model is gathered in one place: each shard holds its keys' share.

Probabilities are smoothed by a Dirichlet prior, with c counts in training:

    p(w | v) = (c(v w) + mu * p(w)) / (c(v) + mu),  p(w) = (c(w) + 1) / (N + V + 1)

mu is the one of MUS that gives the training documents, each token left out of
the counts in turn, the highest probability.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKEN_BYTES, UNKNOWN, bytes_of, hashed_words, materialize, mix, slices
from .elias_fano import LEVELS, Trie

#: Bytes of text in a chunk, and of the table of texts for each shard.
CHUNK, SHARD = 4 << 20, 8 << 20
MUS = (30.0, 300.0, 3000.0, 30_000.0, 300_000.0)
BEGIN, END = np.uint64(0x5D0C3A1F77B2E649), np.uint64(0x2E8B1D94C6F05A33)
#: Bits of a context's and of a successor's name; the shard adds to both.
CONTEXT_BITS, WORD_BITS = 28, 36


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpack(blob: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, in as many bytes each as the largest needs; the first byte tells."""
    if not len(keys):
        return b""
    step = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    return bytes([width]) + step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack_keys(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, blob[0])
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : blob[0]] = raw
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


class Chunk:
    """The tokens of some texts: each text's words, then its end."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, shards: int):
        h, row, _, _ = hashed_words(raw, offsets, TOKEN_BYTES)
        n = len(offsets) - 1
        size = np.bincount(row, minlength=n) + 1
        self.past = np.cumsum(size)
        self.doc = np.repeat(np.arange(n), size)
        word = np.full(int(self.past[-1]) if n else 0, END)
        word[np.arange(len(h)) + row] = h
        before = np.concatenate([[BEGIN], word[:-1]])[: len(word)]
        before[(self.past - size)[: n]] = BEGIN
        self.words, self.word = np.unique(word, return_inverse=True)
        pair = (mix(before) >> np.uint64(64 - CONTEXT_BITS)) << np.uint64(WORD_BITS) | mix(word * np.uint64(3)) >> np.uint64(64 - WORD_BITS)
        self.pairs, one, self.pair = np.unique(pair, return_index=True, return_inverse=True)
        self.word_shard = word_shard(self.words, shards)
        self.pair_shard = pair_shard(before[one], word[one], shards)
        known = np.searchsorted(self.words, before)
        known[before == BEGIN] = np.searchsorted(self.words, END)
        self.before = known  # a beginning is as frequent as an end


def word_shard(words: np.ndarray, shards: int) -> np.ndarray:
    return ((words >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def pair_shard(contexts: np.ndarray, words: np.ndarray, shards: int) -> np.ndarray:
    """A grid over contexts and successors: a hot context is spread over a row of it.

    It goes by other bits of the hashes than the names of a pair, so a pair is
    told from others by its shard too: names grow as the shards do.
    """
    across = max(1, math.isqrt(shards))
    down = shards // across
    return ((mix(contexts + np.uint64(11)) % np.uint64(down)) * np.uint64(across) + mix(words + np.uint64(13)) % np.uint64(across)).astype(np.int64)


def _chunks(docs: DataFrame, train) -> DataFrame:
    source = docs.select("doc_id", train.alias("train"), F.col("text").cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, raw, offsets in slices(batch.column("text"), CHUNK):
                own = batch.slice(a, b - a)
                ids = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), own.column("doc_id"))
                flags = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), own.column("train"))
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | k], pa.int64()), ids, flags, pa.array([_pack(offsets)]), pa.array([_pack(raw)])], names=["chunk", "ids", "train", "offsets", "raw"])
                k += 1

    return source.mapInArrow(run, f"chunk bigint, ids array<{id_type}>, train array<boolean>, offsets binary, raw binary")


def _opened(offsets: bytes, raw: bytes, n: int, shards: int) -> Chunk:
    places = _unpack(offsets, n + 1, np.int64)
    return Chunk(_unpack(raw, int(places[-1]), np.uint8), places, shards)


def _requests(chunks: DataFrame, shards: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for chunk, train, offsets, raw in zip(*(batch.column(c).to_pylist() for c in ("chunk", "train", "offsets", "raw"))):
                c = _opened(offsets, raw, len(train), shards)
                seen = np.array(train, np.float64)[c.doc]
                rows = []
                for keys, inverse, shard in ((c.words, c.word, c.word_shard), (c.pairs, c.pair, c.pair_shard)):
                    counts = np.bincount(inverse, seen, len(keys)).astype(np.uint32)
                    order = np.argsort(shard, kind="stable")
                    edges = np.searchsorted(shard[order], np.arange(shards + 1))
                    rows.append([(_pack_keys(keys[o]), _pack(counts[o])) for o in (order[x:y] for x, y in zip(edges, edges[1:]))])
                some = [s for s in range(shards) if rows[0][s][0] or rows[1][s][0]]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(some), pa.int64()), pa.array(some, pa.int32()), *(pa.array([rows[k][s][j] for s in some], pa.binary()) for k in range(2) for j in range(2))], names=["chunk", "shard", "words", "word_counts", "pairs", "pair_counts"])

    return chunks.select("chunk", "train", "offsets", "raw").mapInArrow(run, "chunk bigint, shard int, words binary, word_counts binary, pairs binary, pair_counts binary")


def _grouped(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of several ascending lists, and the place of each key of the lists among them."""
    every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    every = every[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    place = np.empty(len(every), np.int64)
    place[order] = np.cumsum(new) - 1
    return every[new], place


def _answers(requests: DataFrame, shards: int) -> DataFrame:
    """Per chunk and shard the counts of its words and the count codes of its pairs; chunk -1 has totals."""

    def solved(shard, rows):
        words = [_unpack_keys(r[1]) for r in rows]
        pairs = [_unpack_keys(r[3]) for r in rows]
        n_words, n_pairs = [len(w) for w in words], [len(p) for p in pairs]
        known, word = _grouped(words)
        count = np.bincount(word, np.concatenate([_unpack(r[2], n, np.uint32) for r, n in zip(rows, n_words)]), len(known)).astype(np.int64)
        del words
        keys, pair = _grouped(pairs)
        seen = np.bincount(pair, np.concatenate([_unpack(r[4], n, np.uint32) for r, n in zip(rows, n_pairs)]), len(keys)).astype(np.int64)
        del pairs
        mask = np.uint64((1 << WORD_BITS) - 1)
        learnt = keys[seen > 0]
        trie = Trie(learnt >> np.uint64(WORD_BITS), learnt & mask, seen[seen > 0], WORD_BITS)
        # Every distinct key is looked up once, in order, for all chunks that ask for it.
        code = trie.codes_of(keys >> np.uint64(WORD_BITS), keys & mask)
        word_edge, pair_edge = np.cumsum([0, *n_words]), np.cumsum([0, *n_pairs])
        for k, r in enumerate(rows):
            w, p = word[word_edge[k] : word_edge[k + 1]], pair[pair_edge[k] : pair_edge[k + 1]]
            yield r[0], shard, _pack(count[w].astype(np.uint64)), len(w), _pack(code[p]), len(p), 0, 0
        yield -1, shard, b"", 0, b"", 0, int(count.sum()), int((count > 0).sum())

    def run(batches):
        def out(shard, rows):
            found = list(zip(*solved(shard, rows)))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(found, kinds)], names=["chunk", "shard", "words", "n_words", "pairs", "n_pairs", "tokens", "types"])

        at, held = None, []
        for batch in batches:
            for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "chunk", "words", "word_counts", "pairs", "pair_counts"))):
                if shard != at:
                    if held:
                        yield out(at, held)
                    at, held = shard, []
                held.append(row)
        if held:
            yield out(at, held)

    dealt = requests.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "chunk bigint, shard int, words binary, n_words bigint, pairs binary, n_pairs bigint, tokens bigint, types bigint")


def score_texts(docs: DataFrame, train=None, shards: int | None = None) -> DataFrame:
    """Per document: doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` is a condition on the columns of ``docs`` that tells what to
    learn from (all rows by default; null counts as true). Tokens are the words
    (not blanks; A-Z in lower case) and an end. base_score is the add-one
    unigram's and score the pair model's log10 probability of the text. Null
    texts are empty; repeated rows are learnt and scored each; other columns
    are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    size = bytes_of(docs.select("text"))
    if not shards:
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD) if size < UNKNOWN else 0)
    chunks = materialize(_chunks(docs, F.coalesce(train, F.lit(True)) if train is not None else F.lit(True)))
    answers = materialize(_answers(_requests(chunks, shards), shards))
    total = answers.where("chunk = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    tokens, types = int(total[0]), int(total[1])
    id_type = docs.schema["doc_id"].dataType.simpleString()
    left = chunks.select("chunk", F.lit(-1).alias("shard"), F.col("offsets").alias("words"), F.lit(0).cast("bigint").alias("n_words"), F.col("raw").alias("pairs"), F.lit(0).cast("bigint").alias("n_pairs"), "ids", "train")
    right = answers.where("chunk >= 0").select("chunk", "shard", "words", "n_words", "pairs", "n_pairs", F.lit(None).cast(f"array<{id_type}>").alias("ids"), F.lit(None).cast("array<boolean>").alias("train"))

    def scored(head, parts):
        ids, train_flags = head[4], head[5]
        c = _opened(head[0], head[2], len(train_flags), shards)
        count, code = np.zeros(len(c.words)), np.zeros(len(c.pairs), np.uint8)
        word_of, pair_of = c.word_shard, c.pair_shard
        word_order, pair_order = np.argsort(word_of, kind="stable"), np.argsort(pair_of, kind="stable")
        word_edge, pair_edge = (np.searchsorted(s[o], np.arange(shards + 1)) for s, o in ((word_of, word_order), (pair_of, pair_order)))
        for shard, w, n_w, p, n_p in parts:
            count[word_order[word_edge[shard] : word_edge[shard + 1]]] = _unpack(w, n_w, np.uint64)
            code[pair_order[pair_edge[shard] : pair_edge[shard + 1]]] = _unpack(p, n_p, np.uint8)
        n = len(train_flags)
        own, together, before = count[c.word], LEVELS[code][c.pair], count[c.before]
        if not (c.word.size and np.any(c.words == END)):
            before = np.zeros(len(own))
        add = lambda x: np.bincount(c.doc, x, n)
        base = add(np.log10(own + 1) - math.log10(tokens + types + 1))
        p = (own + 1) / (tokens + types + 1)
        less = np.maximum(own, 1) / (tokens + types + 1)
        scores = np.stack([add(np.log10((together + mu * p) / (before + mu))) for mu in MUS], 1)
        alone = np.stack([add(np.log10((np.maximum(together - 1, 0) + mu * less) / (np.maximum(before - 1, 0) + mu))) for mu in MUS], 1)
        listed = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([ids, pa.array(train_flags, pa.bool_()), pa.array(np.bincount(c.doc, minlength=n)), pa.array(add(own > 0).astype(np.int64)), pa.array(base), listed(scores), listed(alone)], names=["doc_id", "train", "n_tokens", "n_known", "base_score", "scores", "alone"])

    def run(batches):
        at, head, parts = None, None, []
        for batch in batches:
            ids = batch.column("ids")
            for k, (chunk, shard, w, n_w, p, n_p, train_flags) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chunk", "shard", "words", "n_words", "pairs", "n_pairs", "train")))):
                if chunk != at:
                    if head is not None:
                        yield scored(head, parts)
                    at, head, parts = chunk, None, []
                if shard < 0:
                    head = w, n_w, p, n_p, ids[k].values, train_flags
                else:
                    parts.append((shard, w, n_w, p, n_p))
        if head is not None:
            yield scored(head, parts)

    both = left.unionByName(right).repartition("chunk").sortWithinPartitions("chunk", "shard")
    found = materialize(both.mapInArrow(run, f"doc_id {id_type}, train boolean, n_tokens bigint, n_known bigint, base_score double, scores array<double>, alone array<double>"), gather=True)
    sums = found.where("train").agg(*[F.coalesce(F.sum(F.col("alone")[k]), F.lit(0.0)) for k in range(len(MUS))]).first()
    best = int(np.argmax(sums))
    return found.select("doc_id", "train", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", F.col("scores")[best].alias("score"))
