import zlib

import numpy as np
import pytest

from tessara.llm.quality import NEIGHBOURS, POWER, LatentVoter, fit, score_quality, shape, terms_of, training_rows
from tessara.llm.queries import op7_quality

FOLDER = "/root/testdata/sf0.1"


def test_shapes_and_terms():
    assert [shape(w) for w in ("Hello", "HELLO!!", "a1b22", "x###", "éÉ", "|", "a-" * 40)] == ["Aa", "A!!", "a9a9", "a###", "aA", "|", "a-" * 40]
    assert terms_of(None) == terms_of(" \n") == {}
    assert terms_of("a a a B") == {"sa": 0.75, "wa": 0.75, "sA": 0.25, "wb": 0.25, "=2": 0.5, "=3": 0.25}
    long = "x" * 5000
    assert terms_of(long) == {"sa": 1.0, "w" + long: 1.0}


def tables(frame):
    good = [(i, f"Some plain words number {i} stand in this text, and they end well.", "en") for i in range(0, 200, 2)]
    bad = [(i, f"BUY!! NOW!! {i}$$$ ### BUY!! NOW!!", "en") for i in range(1, 200, 2)]
    docs = frame("doc_id long, text string, __quality string, score int", [(i, t, x, 0) for i, t, x in good + bad] + [(900, None, "", 0), (901, "", "", 0), (None, "plain words", "", 0), (0, good[0][1], "", 0), (902, "word " * 200_000, "", 0)])
    labels = frame("doc_id long, quality int, toxic int", [(i, 1 - i % 2, None) for i in range(150)] + [(None, 1, 0), (3, None, 0), (4, 0, 0), (5000, 1, 1)])
    return docs, labels


def test_votes(frame):
    docs, labels = tables(frame)
    rows = score_quality(docs, labels).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add(r.score)
    assert len(rows) == docs.count() and all(len(s) == 1 and 0 <= min(s) <= 1 for s in got.values())
    assert all(min(got[i]) > 0.7 for i in range(150, 200, 2)) and all(max(got[i]) < 0.3 for i in range(151, 200, 2))
    assert got[900] == got[901]


def test_held_out_labels_are_never_learnt(frame):
    docs, labels = tables(frame)
    ids = [r.doc_id for r in training_rows(labels).collect()]
    assert len(ids) == len(set(ids)) and all(zlib.crc32(str(i).encode()) % 5 for i in ids) and None not in ids
    assert training_rows(labels, 10).count() == 10
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = (sorted((repr(r.doc_id), r.score) for r in score_quality(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_votes_match_brute_force(frame):
    """Terms, weights, cosines and votes by plain loops over the same space."""
    rng = np.random.default_rng(2)
    said = [" ".join(rng.choice(["plain", "words", "Stand", "BUY!!", "9$", "x", "yes"], rng.integers(1, 30))) for _ in range(240)]
    docs = frame("doc_id long, text string", list(enumerate(said)))
    labels = frame("doc_id long, quality int", [(i, int(rng.integers(2))) for i in range(160)])
    model = fit(docs, labels)
    terms, told = list(model.terms), 0
    for text, fast in zip(said, model.score(said)):
        x = [0.0] * len(terms)
        for k, t in enumerate(terms):
            x[k] = terms_of(text).get(t, 0.0) ** 0.5 * float(model.idf[k])
        size = sum(v * v for v in x) ** 0.5
        point = [sum(v / size * float(model.space[k, d]) for k, v in enumerate(x)) for d in range(model.space.shape[1])]
        size = sum(v * v for v in point) ** 0.5
        cosines = sorted(((sum(v / size * float(w) for v, w in zip(point, other)), int(y)) for other, y in zip(model.vectors, model.labels)), reverse=True)
        if cosines[NEIGHBOURS - 1][0] - cosines[NEIGHBOURS][0] > 1e-5:  # ties at the last place may go either way
            near = cosines[:NEIGHBOURS]
            assert fast == pytest.approx(sum(c**POWER * y for c, y in near) / sum(c**POWER for c, _ in near), abs=1e-3)
            told += 0 < fast < 1
    assert told > 100 and len(model.labels) > 100


def test_nothing_to_learn_from(frame):
    docs, labels = tables(frame)
    assert {r.score for r in score_quality(docs, labels.where("false")).collect()} == {0.5}
    assert score_quality(docs.where("false"), labels).count() == 0
    assert LatentVoter([], np.zeros((0, 0), np.float32), np.zeros(0)).score(["a"])[0] == 0.5


def test_held_out_accuracy(spark):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = [r for r in op7_quality(spark, FOLDER).collect() if r.held_out and r.doc_id in quality]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.predicted == (r.score >= 0.3) for r in rows)
    good, bad = ([r.score for r in rows if quality[r.doc_id] == y] for y in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert len(rows) > 500 and auc > 0.98 and np.mean([r.predicted == quality[r.doc_id] for r in rows]) > 0.97
