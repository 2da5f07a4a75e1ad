import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessara.llm.components import roots


@given(st.integers(1, 60), st.lists(st.tuples(st.integers(0, 59), st.integers(0, 59)), max_size=80))
@settings(max_examples=200, deadline=None)
def test_roots_match_brute_force(n, edges):
    edges = [(a % n, b % n) for a, b in edges]
    least = list(range(n))
    for _ in range(n):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    a, b = np.array(edges, np.int64).reshape(-1, 2).T
    assert roots(n, a, b).tolist() == least


def test_roots_of_long_chains_and_stars():
    n = 100_000
    order = np.random.default_rng(0).permutation(n)
    assert (roots(n, order[:-1], order[1:]) == 0).all()
    assert (roots(n, np.arange(n - 1), np.full(n - 1, n - 1)) == 0).all()
    assert (roots(n, np.zeros(0, np.int64), np.zeros(0, np.int64)) == np.arange(n)).all()
