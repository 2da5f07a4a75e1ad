"""Line dedup against the definition of repeated runs, not of windows."""

import random

import brute
import pytest

from tessara.llm.line_dedup import dedup_lines

SPACE = " \t\n\v\f\r"


def without_later_runs(docs, least=51):
    """Text left per document: every run of at least ``least`` words that starts at an earlier place too is deleted."""
    full = [[(k, x.strip(SPACE)) for k, x in enumerate(text.split("\n")) if x.strip(SPACE)] for text in docs]
    first, gone = {}, [set() for _ in docs]
    for d, lines in enumerate(full):
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(x for _, x in lines[a:b])
                if sum(len(brute.TOKEN.findall(x)) for x in run) >= least and first.setdefault(run, (d, a)) != (d, a):
                    gone[d].update(range(lines[a][0], lines[b - 1][0] + 1))
    return ["\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[d]) for d, text in enumerate(docs)]


def left(frame, docs, least=51):
    return [r.text for r in dedup_lines(frame("doc_id long, text string", list(enumerate(docs))), least).orderBy("doc_id").collect()]


def line(mark, n):
    return " ".join(f"{mark}{k}" for k in range(n))


@pytest.mark.parametrize("sizes", [(30, 30, 5), (60, 44), (60, 1, 1, 48)])
def test_whole_runs_go(frame, sizes):
    run = "\n".join(line(f"r{k}x", n) for k, n in enumerate(sizes))
    assert left(frame, [f"{run}\nbefore this", f"own\n{run}\n\nother {line('y', 60)}"]) == [f"{run}\nbefore this", f"own\n\nother {line('y', 60)}"]


def test_runs_match_their_definition(frame):
    rng = random.Random(9)
    docs = ["\n".join(rng.choice(["a", "b b", "c c c", "", "d", "e e e e e e"]) for _ in range(rng.randrange(14))) for _ in range(60)]
    for least in (5, 8):
        want = without_later_runs(docs, least)
        assert left(frame, docs, least) == want and want != docs
