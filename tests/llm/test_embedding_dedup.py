import brute
import numpy as np
import pytest

from tessara.llm import embedding_dedup as e
from tessara.llm.queries import op4_embeddings

FOLDER = "/root/testdata/sf0.01"


def check(found, ids, vectors, threshold=0.95):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    g, links = brute.Groups(len(ids)), [0] * len(ids)
    unit = [np.array(v, float) / np.abs(v).max() if ok else None for v, ok in zip(vectors, good)]
    for i in range(len(ids)):
        for j in range(i):
            if good[i] and good[j] and len(vectors[i]) == len(vectors[j]):
                a, b = unit[i], unit[j]
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    g.join(i, j)
    want = {ids[k]: (links[k], ids[g.find(k)], g.find(k) == k) for k in range(len(ids))}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found.collect()} == want


def clustered(n, dims, seed, noise):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 6, dims))
    return (centre[rng.integers(0, len(centre), n)] + noise * rng.normal(size=(n, dims))).astype(np.float32)


@pytest.mark.parametrize(("block", "noise"), [(2048, 0.2), (16, 0.25), (16, 0.05), (7, 0.33)])
def test_matches_all_pairs(frame, monkeypatch, block, noise):
    monkeypatch.setattr(e, "BLOCK", block)
    x = clustered(240, 32, block, noise)
    vectors = [list(map(float, v)) for v in x]
    df = frame("vec_id long, embedding array<float>, v string, id int", [(i, v, "clash", 0) for i, v in enumerate(vectors)])
    check(e.embedding_duplicates(df), list(range(len(vectors))), vectors)


def test_odd_vectors(frame):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], [2.0, 4.0], [1.0, 2.0], [0.0, 0.0], None, [nan, 1.0], [inf, 1.0], [None, 1.0], [], [1.0, 2.0, 3.0], [-1.0, -2.0], [1e200, 2e200], [1e-200, 2e-200], [0.0, 1.0], [-0.0, 1.0], [5.0], [7.0]]
    df = frame("vec_id long, embedding array<double>", list(enumerate(vectors)))
    check(e.embedding_duplicates(df), list(range(len(vectors))), vectors)


def test_repeats_and_nulls(frame):
    df = frame("vec_id long, embedding array<float>", [(3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 0.0]), (1, [0.0, 1.0]), (None, None)])
    got = sorted((repr(r.vec_id), r.n_links, repr(r.component_id), r.kept) for r in e.embedding_duplicates(df).collect())
    assert got == [("1", 0, "1", True), ("3", 2, "3", True), ("3", 2, "3", True), ("None", 0, "None", True), ("None", 2, "3", False)]
    assert e.embedding_duplicates(df.where("false")).count() == 0 and e.embedding_duplicates(df.where("embedding is null")).first().kept


@pytest.mark.parametrize("steps", [(8, 24), (1, 2), ()])
def test_tiles_give_up_no_pair(monkeypatch, steps):
    monkeypatch.setattr(e, "STEPS", steps)
    a, b = clustered(300, 40, 1, 0.2).astype(float), clustered(280, 40, 1, 0.2).astype(float)
    axes = np.linalg.qr(np.random.default_rng(0).normal(size=(40, 40)))[0]
    ua, ub = e.unit(a), e.unit(b)
    i, j = e.tile_links(a, b, axes, 0.95, False)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(list, np.nonzero(ua @ ub.T >= 0.95))))
    i, j = e.tile_links(a, a, axes, 0.95, True)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(list, np.nonzero(np.triu(ua @ ua.T >= 0.95, 1)))))


def test_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    check(op4_embeddings(spark, FOLDER), [r.vec_id for r in rows], [r.embedding for r in rows])
