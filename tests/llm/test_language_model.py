import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessara.llm import language_model as lm
from tessara.llm.elias_fano import EXACT, LEVELS, EliasFano, Trie, quantise
from tessara.llm.queries import op8_language_model

FOLDER = "/root/testdata/sf0.001"


@given(st.lists(st.integers(0, 2**40), max_size=300), st.lists(st.integers(0, 2**40), max_size=20))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values, others):
    values = np.sort(np.array(values, np.uint64))
    e = EliasFano(values)
    assert (e.at(np.arange(len(values))) == values).all()
    asked = np.unique(np.concatenate([values, np.array(others, np.uint64)]))
    at = e.find(asked)
    assert [bool(a >= 0) for a in at] == [x in set(values.tolist()) for x in asked.tolist()]
    assert all(values[a] == x for a, x in zip(at, asked) if a >= 0)


def test_elias_fano_over_many_steps():
    rng = np.random.default_rng(0)
    values = np.unique(rng.integers(0, 1 << 63, 50_000, np.uint64))
    e = EliasFano(values)
    assert (e.find(values) == np.arange(len(values))).all() and (e.find(values + np.uint64(1)) < 0).sum() >= len(values) - 2
    dense = EliasFano(np.arange(20_000))
    assert dense.nbytes < 20_000 and (dense.at(np.array([0, 4095, 4096, 19_999])) == [0, 4095, 4096, 19_999]).all()
    assert EliasFano(np.zeros(10_000)).at(np.array([9_999]))[0] == 0


def test_trie():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 1 << 20, 30_000, np.uint64))
    contexts, words = pairs >> np.uint64(10), pairs & np.uint64(1023)
    counts = rng.integers(1, 5000, len(pairs))
    t = Trie(contexts, words, counts, 10)
    asked = np.arange(1 << 20, dtype=np.uint64)
    codes = t.codes_of(asked >> np.uint64(10), asked & np.uint64(1023))
    assert (codes[pairs.astype(int)] == quantise(counts)).all() and (codes > 0).sum() == len(pairs)
    own, c = t.successors(int(contexts[500]))
    assert (own == words[contexts == contexts[500]]).all() and (c == quantise(counts[contexts == contexts[500]])).all()
    assert len(t.successors(1 << 11)[0]) == 0
    # The pointers decide where a successor is looked for: with those of the next context nothing is found.
    pointers = t.pointers.at(np.arange(t.pointers.n))
    t.pointers = EliasFano(np.append(pointers[1:], pointers[-1] + np.uint64(1)))
    assert not t.codes_of(contexts[contexts < contexts[-1]], words[contexts < contexts[-1]]).any()


def test_successors_of_one_context_over_many_steps():
    words = np.unique(np.random.default_rng(4).integers(0, 1 << 30, 20_000, np.uint64))
    contexts = np.where(np.arange(len(words)) < 9000, np.uint64(3), np.uint64(8))
    order = np.lexsort((words, contexts))
    t = Trie(contexts[order], words[order], np.ones(len(words)), 30)
    for context in (3, 8):
        own = words[contexts == context]
        assert t.codes_of(np.full(len(words), context, np.uint64), words).tolist() == np.isin(words, own).astype(int).tolist()


def test_quantised_counts_never_exceed_the_true_ones():
    n = np.unique(np.geomspace(1, 1e13, 5000).astype(np.int64))
    got = LEVELS[quantise(n)]
    assert (got <= n).all() and (got * 1.31 >= n).all() and LEVELS[-1] > 1e13
    assert (got[n <= EXACT] == n[n <= EXACT]).all()


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
@settings(max_examples=50, deadline=None)
def test_packed_keys(keys):
    keys = np.unique(np.array(keys, np.uint64))
    assert (lm._unpack_keys(lm._pack_keys(keys)) == keys).all()


TEXTS = ["The cat sat.", "the CAT sat.", "a cat  sat\ton\nit", "", None, " ", "unseen words here", "x " * 50_000, "É é É", "the cat sat."]


def scored(frame, texts, train, **options):
    df = frame("doc_id long, text string, train string, chunk int", [(i, t, "clash", 1) for i, t in enumerate(texts)])
    return {r.doc_id: r for r in lm.score_texts(df, F.col("doc_id").isin(train), **options).collect()}


@pytest.mark.parametrize("shards", [1, 5])
def test_base_score(frame, shards):
    train = [0, 1, 2, 3, 4, 5, 7, 9]
    got = scored(frame, TEXTS, train, shards=shards)
    n, want = brute.unigram([TEXTS[i] for i in train], TEXTS)
    for i, (size, known, score) in enumerate(want):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.train) == (size, known, n, i in train) and r.base_score == pytest.approx(score, rel=1e-9)
        assert r.score < 0
    assert got[0].score == got[1].score == got[9].score > got[6].score


def test_pair_model_is_the_smoothed_one(frame, monkeypatch):
    monkeypatch.setattr(lm, "MUS", (10.0,))
    train = ["a b a b a b", "b a", "a a c"]
    texts = [*train, "a b d", "c"]
    got = scored(frame, texts, [0, 1, 2])
    from collections import Counter

    sequences = [["^", *brute.tokens(t), "$"] for t in texts]
    one, two = Counter(w for s in sequences[:3] for w in s), Counter(p for s in sequences[:3] for p in zip(s, s[1:]))
    n, v = sum(one.values()) - one["^"], len(one) - 1
    for i, s in enumerate(sequences):
        want = sum(np.log10((two[a, b] + 10 * (one[b] + 1) / (n + v + 1)) / (one[a] + 10)) for a, b in zip(s, s[1:]))
        assert got[i].score == pytest.approx(want, rel=1e-9)


def test_probabilities_of_next_words_add_up_to_one_at_most(frame, monkeypatch):
    monkeypatch.setattr(lm, "MUS", (5.0,))
    train = ["a b", "a c", "a b"]
    got = scored(frame, [*train, "a", "a a", "a b", "a c", "a zz"], [0, 1, 2])
    first = got[3].score  # "a", then the end
    step = lambda i, j: 10 ** (got[i].score - j)
    assert 10**first < 1 and sum(10 ** got[i].score for i in range(3, 8)) < 1 and step(5, 0) > step(7, 0)


def test_chunks_and_repeats(frame, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 20)
    train = list(range(8))
    a = scored(frame, TEXTS, train)
    monkeypatch.setattr(lm, "CHUNK", 1 << 22)
    b = scored(frame, TEXTS, train)
    assert all(a[i].score == pytest.approx(b[i].score, rel=1e-9) and a[i].base_score == pytest.approx(b[i].base_score, rel=1e-9) for i in a)
    df = frame("doc_id long, text string", [(1, "a b"), (1, "a b"), (None, "a b"), (2, None)])
    rows = lm.score_texts(df).collect()
    assert len(rows) == 4 and len({r.score for r in rows if r.n_tokens == 3}) == 1


def test_nothing_to_learn_from(frame):
    assert lm.score_texts(frame("doc_id long, text string", [])).count() == 0
    got = scored(frame, ["a b"], [])
    assert got[0].train_tokens == 0 and got[0].base_score == 0


def test_query_beats_the_base_on_held_out_texts(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    fold = {i: zlib.crc32(str(i).encode()) % 7 for i, _ in docs}
    n, want = brute.unigram([t for i, t in docs if fold[i] != 2], [t for _, t in docs])
    got = {r.doc_id: r for r in op8_language_model(spark, FOLDER).collect()}
    for (i, _), (size, known, score) in zip(docs, want):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (size, known, n, fold[i] == 2) and r.base_score == pytest.approx(score, rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
