import random

import brute
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessara.llm.line_dedup import dedup_lines, suffix_ranks, without_ranges
from tessara.llm.queries import op9_line_dedup

FOLDER = "/root/testdata/sf0.001"


def check(spark, frame, docs, least=51):
    df = frame("doc_id long, text string, n_lines string, words int", [(*d, "clash", 1) for d in docs])
    out = dedup_lines(df, least)
    assert out.columns == ["doc_id", "text", "words", "n_lines", "n_deleted"]
    want = brute.without_later_runs(docs, least)
    got = sorted(repr((r.doc_id, r.text)) for r in out.collect())
    assert got == sorted(repr((d[0], want[d])) for d in docs)
    return out


def test_repeated_runs(spark, frame):
    rng = random.Random(5)
    line = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1, 25)))
    runs = [[line() for _ in range(rng.randrange(1, 12))] for _ in range(12)]
    short = [line()[:20] for _ in range(4)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            lines += rng.choice([lambda: rng.choice(runs), lambda: [rng.choice(short)], lambda: [line()], lambda: ["", "  "]])()
        docs.append((i, "\n".join(lines)))
    docs += [(3, docs[5][1]), (None, docs[6][1]), (70, None), (71, ""), (72, "\n\n"), (5, docs[5][1]), (73, "\n".join(["same line again"] * 300)), (74, " ".join(f"v{k}" for k in range(60)) + "\r\nend"), (75, " ".join(f"v{k}" for k in range(60)) + "\nend"), (76, "x\n" * 5000 + "y")]
    check(spark, frame, docs)


@given(st.lists(st.lists(st.sampled_from(["a", "b b", "c c c", "", "d"]), max_size=9), max_size=5))
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_random_lines(spark, frame, docs):
    check(spark, frame, [(i, "\n".join(x)) for i, x in enumerate(docs)], 5)


def test_short_repeats_and_unique_text_stay(spark, frame):
    licence = "Licensed under some licence, version 2."
    docs = [(i, f"{licence}\nunique text {i} " + f"word{i} " * 60) for i in range(5)]
    assert check(spark, frame, docs).where("n_deleted > 0").count() == 0
    check(spark, frame, [])


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    want = brute.without_later_runs(docs)
    assert {(r.doc_id, r.text) for r in op9_line_dedup(spark, FOLDER).collect()} == {(d[0], want[d]) for d in docs}


def test_ranks_are_those_of_a_sorted_list(spark, frame):
    rng = random.Random(3)
    rows = [(p, 0, 1, 1, 1, rng.choice([0, 0, 0, 7, -5, rng.randrange(400)]), rng.randrange(30)) for p in range(3000)]
    names = sorted({r[5:] for r in rows})
    shared = {n for n in names if sum(r[5:] == n for r in rows) > 1}
    got = suffix_ranks(frame("place long, nth int, left int, m int, most int, a long, b long", rows).repartition(7), "a", "b", 3).collect()
    assert {r.place: r["rank"] for r in got} == {r[0]: names.index(r[5:]) for r in rows if r[5:] in shared} and len(got) > 1000


def test_runs_are_found_whatever_their_length(spark, frame):
    rng = random.Random(4)
    run = [f"line {k} {rng.randrange(10**9)}" for k in range(700)]
    docs = [(1, "\n".join(["head", *run, "tail"])), (2, "\n".join(["other head", *run[:333], "middle", *run[300:], "x"])), (3, "\n".join(run))]
    left = {r.doc_id: r.text for r in dedup_lines(frame("doc_id long, text string", docs)).collect()}
    assert left == {1: docs[0][1], 2: "other head\nmiddle\nx", 3: ""}


def test_ranges_may_overlap():
    assert without_ranges(list("abcdef"), [(1, 2), (1, 3), (2, 2), (5, 5)]) == ["a", "e"]


def test_many_runs_in_one_text(spark, frame):
    lines = [f"w{k} " * 60 for k in range(8000)]
    docs = [(1, "\n".join(lines)), (2, "\n".join(x for k in range(8000) for x in (lines[k], f"own {k}")))]
    left = {r.doc_id: r.n_deleted for r in dedup_lines(frame("doc_id long, text string", docs)).collect()}
    assert left == {1: 0, 2: 8000}
