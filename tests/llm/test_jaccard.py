import random

import brute
import pytest

from tessara.llm import common, jaccard
from tessara.llm.components import components
from tessara.llm.jaccard import bands_for, drop_near_duplicates, near_duplicates
from tessara.llm.queries import op5_jaccard

FOLDER = "/root/testdata/sf0.001"


def corpus(seed=3):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 160))] for _ in range(30)]
    texts = []
    for b in base:
        for _ in range(rng.randrange(1, 6)):
            w = list(b)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = "edit%d" % rng.randrange(99)
            texts.append(" ".join(w))
    texts += ["one two three", "One, two; THREE", "one two", "", None, "...", "a b c d e f g", "a b c d e f g", "y " * 30_000, "y " * 20_000]
    return list(enumerate(texts))


def check(found, docs):
    links, group = brute.similar([t for _, t in docs])
    ids = [i for i, _ in docs]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_grams) for r in found.collect()}
    assert got == {i: (ids[group[k]], links[k], len(brute.grams(docs[k][1]))) for k, i in enumerate(ids)}


SCHEMA = "doc_id long, text string, v int, bands string"


def frame_of(frame, docs):
    return frame(SCHEMA, [(*d, 0, "clash") for d in docs])


def test_matches_all_pairs(frame):
    docs = corpus()
    check(near_duplicates(frame_of(frame, docs)), docs)


@pytest.mark.parametrize("block", [3, 7])
def test_large_groups_in_tiles(frame, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    rng = random.Random(1)
    base = [f"w{k}" for k in range(300)]
    docs = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(300)] = f"x{rng.random()}"
        docs.append((i, " ".join(w)))
    check(near_duplicates(frame_of(frame, docs)), docs)


def test_nulls_repeats_and_one_of_each_class(frame):
    long = " ".join(f"w{k}" for k in range(100))
    docs = [(5, long), (5, long), (3, long + " more"), (None, long), (9, "alone here now ok fine"), (9, "alone here now ok fine"), (1, None), (1, None), (2, ""), (None, None)]
    df = frame_of(frame, docs)
    got = sorted((repr(r.doc_id), repr(r.class_id), r.n_links) for r in near_duplicates(df).collect())
    assert got == sorted([("5", "3", 3)] * 2 + [("3", "3", 3), ("None", "3", 3)] + [("9", "9", 1)] * 2 + [("1", "1", 0)] * 2 + [("2", "2", 0), ("None", "None", 0)])
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "3", "9", "None"]


def test_empty_table(frame):
    df = frame_of(frame, [])
    assert near_duplicates(df).count() == 0 and drop_near_duplicates(df).count() == 0


def test_bands():
    b = bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**jaccard.ROWS) ** b >= 0.9999 > 1 - (1 - 0.8**jaccard.ROWS) ** (b - 1)


def test_components_of_chains_and_stars(frame):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(1000, 1200)] + [(7, k) for k in range(2000, 2300)] + [(5000 - k, 4999 - k) for k in range(100)] + [(1, 1)]
    rng.shuffle(edges)
    got = {r.v: r.root for r in components(frame("u long, v long", edges).repartition(9)).collect()}
    assert {r for v, r in got.items() if 1000 <= v <= 1200} == {1000} and {r for v, r in got.items() if v == 7 or 2000 <= v < 2300} == {7} and {r for v, r in got.items() if v >= 4900} == {4900} and 1 not in got
    assert components(frame("u long, v long", [])).count() == 0


def test_bitmap_has_no_false_negatives(spark, frame, monkeypatch):
    for size in (4, 1 << 20):
        monkeypatch.setattr(common, "BITMAP_WORDS", size)
        df, members = spark.range(1000).selectExpr("xxhash64(id) AS k", "id"), spark.range(0, 1000, 7).selectExpr("xxhash64(id) AS key")
        maybe = {r.id for r in common.flagged(df, "k", members, "key").where("__maybe").collect()}
        assert set(range(0, 1000, 7)) <= maybe
    assert len(maybe) < 160


def test_query(spark):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    check(op5_jaccard(spark, FOLDER), docs)
