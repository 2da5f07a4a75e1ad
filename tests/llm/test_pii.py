import hashlib

import brute
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessara.llm.pii import find_private, sanitise, spans_text
from tessara.llm.queries import op6_pii

FOLDER = "/root/testdata/sf0.001"
TEXTS = [
    "a@b.c_d@e.f.g @x.y .a@b..c 1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.0255", "4111 1111 1111 1111- 4111-1111-1111-1112 +1 (555) 123-4567 ) +1+12345678901 é4111111111111111", None, "", "no data",
    "9" * 50_000 + "." + "9" * 50_000 + " " + "a" * 100_000 + "@", "1 1" * 20_000, "\U0001f600 é x@y.zz +4912345678 ü 10.0.0.255", "+1(((", "@", "a@b", "1.2.3", "\n\na.b+c@d-e.f\n",
]


def spans(found):
    return found.select("doc_id", spans_text(F.col("base")).alias("s"))


def test_patterns_match_brute_force(frame):
    df = frame("doc_id long, text string, spans string, row int", [(i, t, "clash", 0) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "", 0), (None, TEXTS[0], "", 1)])
    got = sorted((repr(r.doc_id), r.s) for r in spans(find_private(df)).collect())
    assert got == sorted([(repr(i), ",".join(brute.personal(t))) for i, t in enumerate(TEXTS)] + [(repr(i), ",".join(brute.personal(TEXTS[0]))) for i in (0, None)])


@given(st.lists(st.text("a1@.- +(_é\n", max_size=60), min_size=1, max_size=30))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_random_texts(frame, texts):
    got = {r.doc_id: r.s for r in spans(find_private(frame("doc_id long, text string", list(enumerate(texts))))).collect()}
    assert got == {i: ",".join(brute.personal(t)) for i, t in enumerate(texts)}


def disclosing(frame):
    filler = " ".join(f"common{chr(97 + k % 26)}" for k in range(400))
    rows = [(i, f"{filler} Doctor Quillby{'' if i else ' twice'} wrote from q@mail.example commona number {i}") for i in range(6)]
    return frame("doc_id long, text string", rows + [(10, filler), (11, f"commona z{filler}")])


def test_terms_that_disclose(frame):
    df = disclosing(frame)
    found = {r.doc_id: [(s.kind, df.where(F.col("doc_id") == r.doc_id).first().text[s.start : s.end]) for s in r.spans] for r in find_private(df).collect()}
    terms = {t for k, t in found[3] if k == 4}
    assert {"Quillby", "Doctor", "wrote"} <= terms and not any("common" in t for t in terms)
    assert found[10] == found[11] == []
    lone = frame("doc_id long, text string", [(1, "Quillby wrote from q@mail.example")])
    assert [s.kind for s in find_private(lone).first().spans] == [0]


def test_terms_match_brute_force(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()] * 1
    docs += [f"zqx{i % 3} wqy lives at home.{i % 2}@mail.example and zqx{i % 3} calls 10.1.1.{i % 3}, so wqyzt{i % 2} does" for i in range(9)]
    want = brute.disclosing_terms(docs)
    found = find_private(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    got = {r.doc_id: {(s.start, s.end) for s in r.spans if s.kind == 4} for r in found.collect()}
    assert {i: s for i, s in got.items() if s} == want and len(want) >= 9


def test_sanitise(frame):
    df = disclosing(frame)
    clean = {r.doc_id: r.text for r in sanitise(df).collect()}
    assert "Quillby" not in clean[3] and "<email>" in clean[3] and "<term>" in clean[3] and clean[10] == df.where("doc_id = 10").first().text
    gone = {r.doc_id: r.text for r in sanitise(df, generalise=False).collect()}
    assert "<" not in gone[3] and "@" not in gone[3]
    odd = frame("doc_id long, text string, x int", [(1, None, 1), (1, "a@b.c", 2), (1, "a@b.c", 3), (None, "1.2.3.4", 4)])
    assert sorted((r.x, r.text) for r in sanitise(odd).collect()) == [(1, None), (2, "<email>"), (3, "<email>"), (4, "<ip>")]


def test_names_of_any_length_are_marked_in_the_whole_document(frame):
    filler = " ".join(f"common{chr(97 + k % 26)}" for k in range(400))
    rows = [(i, f"Li wrote {i}. {filler} call Li_77 or 李明 on {p} today {i}") for i, p in enumerate(["+49 (30) 123 456 78", "+493012345678", "+49-30-12345678", "+49 30 12345678"])]
    df = frame("doc_id long, text string", [*rows, (10, filler)])
    for r in find_private(df).collect():
        said = [rows[r.doc_id][1][s.start : s.end] for s in r.spans if s.kind == 4] if r.doc_id < 10 else []
        assert r.doc_id == 10 or {"Li_77", "李明"} <= set(said) and "common" not in str(said)
    assert "李明" not in "".join(r.text for r in sanitise(df).collect())


def test_many_spans_in_one_text(frame):
    text = " ".join(f"u{k}@mail.example" for k in range(100_000))
    df = frame("doc_id long, text string", [(1, text), (2, "none")])
    got = {r.doc_id: len(r.base) for r in find_private(df).collect()}
    assert got == {1: 100_000, 2: 0}
    assert {r.doc_id: r.text for r in sanitise(df).collect()} == {1: " ".join(["<email>"] * 100_000), 2: "none"}


def test_empty_table(frame):
    assert find_private(frame("doc_id long, text string", [])).count() == 0


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    df = op6_pii(spark, FOLDER)
    for r in df.collect():
        want = brute.personal(docs[r.doc_id])
        assert hashlib.sha256(",".join(want).encode()).hexdigest() == r.base_sha256 and r.n_email == sum(s.startswith("email") for s in want)
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == want
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
