import brute
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessara.llm import decontamination as d
from tessara.llm.queries import op1_decontamination

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"w{k}" for k in range(40))
ITEMS = [(1, LONG), (2, "Short Item"), (3, None), (None, "null id words"), (4, "... !!"), (10, "short item"), (5, "é à É")]
DOCS = [
    (1, "x " + LONG[:-1] + "9 y"), (2, "a SHORT item b " + "z " * 10), (3, None), (4, ""), (5, LONG), (5, LONG), (6, "short-item," * 3 + " v" * 200),
    (7, "null id words"), (None, "é à É \x00 short item"), (8, "q " * 50_000 + LONG + " r" * 1000), (9, "shortitem short"), (10, "...")
]


def frames(frame, docs=DOCS, items=ITEMS):
    return frame("doc_id long, text string, n_hit string, items int", [(*r, "clash", 1) for r in docs]), frame("item_id long, text string, doc_id int", [(*r, 1) for r in items])


def check(found, docs, items):
    got = sorted((repr(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in found.collect())
    want = [(repr(i), *brute.contamination(t, items)) for i, t in docs]
    assert got == sorted((*w, w[2] > 0 and 20 * w[2] >= w[1]) for w in want)


def test_scan_matches_brute_force(frame):
    docs, items = frames(frame)
    found = d.scan_documents(docs, items)
    check(found, DOCS, ITEMS)
    assert {r.doc_id: [t[s.start : s.end] for s in r.spans for i, t in DOCS if i == r.doc_id] for r in found.where("doc_id = 2").collect()} == {2: ["SHORT item"]}


def test_join_beyond_the_broadcast_bound_agrees(frame, monkeypatch):
    docs, items = frames(frame, [r for r in DOCS if r[0] != 8])
    small = {(r.doc_id, r.n_hit, tuple(r["items"]), tuple(map(tuple, r.spans))) for r in d.scan_documents(docs, items).collect()}
    monkeypatch.setattr(d, "BROADCAST_BYTES", 0)
    found = d.scan_documents(docs, items)
    check(found, [r for r in DOCS if r[0] != 8], ITEMS)
    assert {(r.doc_id, r.n_hit, tuple(r["items"]), tuple(map(tuple, r.spans))) for r in found.collect()} == small
    kept = d.decontaminate(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {3, 4, 6, 7, 9, 10}
    assert d.scan_documents(docs, items.where("item_id = 4")).where("n_hit > 0").count() == 0
    cut = d.decontaminate(docs, items, action="spans")
    assert cut.columns == docs.columns and cut.count() == docs.count() and cut.where("doc_id = 2").first().text == "a  b " + "z " * 10


@pytest.mark.parametrize(("share", "kept"), [(0.3, 0), (0.301, 1), (0.7, 1), (0.05, 0)])
def test_share_is_exact(frame, share, kept):
    docs, items = frames(frame, [(1, "a b c v v v v v v v")], [(1, "a b c")])
    assert d.decontaminate(docs, items, share=share).count() == kept
    assert d.scan_documents(docs, items, share=share).first().contaminated == (not kept)


@given(st.lists(st.text("ab c.É", max_size=60), min_size=1, max_size=4), st.lists(st.text("ab c.É", max_size=40), max_size=3))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_random_texts(frame, texts, said):
    docs, items = list(enumerate(texts)), list(enumerate(said))
    found = d.scan_documents(frame("doc_id long, text string", docs), frame("item_id long, text string", items), 3)
    got = sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect())
    assert got == sorted((i, *brute.contamination(t, items, 3)) for i, t in docs)


def test_removal(frame):
    docs, items = frames(frame)
    assert {r.doc_id for r in d.decontaminate(docs, items).collect()} == {3, 4, 6, 7, 8, 9, 10}
    cut = d.decontaminate(docs, items, action="spans")
    assert cut.columns == docs.columns and cut.count() == len(DOCS)
    assert cut.where("doc_id = 2").first().text == "a  b " + "z " * 10 and cut.where("doc_id = 3").first().text is None
    with pytest.raises(ValueError):
        d.decontaminate(docs, items, action="other")


def test_empty_tables(frame):
    docs, items = frames(frame)
    assert d.scan_documents(docs.where("false"), items).count() == 0
    assert d.scan_documents(docs, items.where("false")).where("n_hit > 0 or contaminated").count() == 0
    assert d.decontaminate(docs, items.where("false")).count() == len(DOCS)


def test_query(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{FOLDER}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in op1_decontamination(spark, FOLDER).collect()}
    assert got == {i: (w, h, len(x), d.digest(x)) for i, t in docs for w, h, x in [brute.contamination(t, items)]}
