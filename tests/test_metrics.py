import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessara.functions import add_diagonal, back_substitution, cholesky, cholesky_solve, dot, euclidean_distance, forward_substitution, log_logistic, norm, row_norms, softmax
from tessara.operators import (
    accuracy_score, as_integers, check_array, check_classification_targets, check_features_consistency, check_xy, class_count, compute_class_weight, compute_sample_weight, confusion_matrix,
    explained_variance_score, f1_score, is_binary_classification, is_multilabel, log_loss, mean_absolute_error, mean_absolute_percentage_error, mean_squared_error, num_features, precision_score,
    r2_score, recall_score, sample_weight, type_of_target, unique_labels,
)
from tessara.plans import matrices

NAN = float("nan")


def value(frame, metric, *rows, **options):
    return frame("y double, p double, w double", [(float(y), float(p), float(w)) for y, p, w in rows]).agg(metric("y", "p", **options).alias("v")).first()["v"]


PERFECT, OFF = [(v, v, 1) for v in (1, 2, 3)], [(v, v + 1, 1) for v in (1, 2, 3)]


@pytest.mark.parametrize(
    ("metric", "rows", "want"),
    [
        (mean_squared_error, PERFECT, 0), (mean_absolute_error, PERFECT, 0), (r2_score, PERFECT, 1), (mean_squared_error, OFF, 1), (r2_score, OFF, -0.5), (explained_variance_score, OFF, 1),
        (r2_score, [(2, 1, 1), (2, 3, 1)], 1), (mean_absolute_percentage_error, [(0, 1, 1), (2, 1, 1)], 0.25), (explained_variance_score, [(2, 1, 1), (2, 3, 1)], 0),
        (mean_squared_error, [], 0), (mean_absolute_error, [], 0), (r2_score, [], 1), (mean_absolute_percentage_error, [], NAN), (explained_variance_score, [], NAN),
    ],
)
def test_regression_metrics(frame, metric, rows, want):
    assert value(frame, metric, *rows) == pytest.approx(want, nan_ok=True)


def test_weighted_regression_metrics(frame):
    rows = [(1, 2, 3), (1, 3, 1)]
    assert value(frame, mean_squared_error, *rows, weight="w") == pytest.approx(7 / 4)
    assert value(frame, mean_squared_error, *rows, weight="w", squared=False) == pytest.approx(math.sqrt(7 / 4))
    assert value(frame, mean_absolute_error, *rows, weight="w") == pytest.approx(5 / 4)
    assert value(frame, mean_squared_error, (1, 2, 0), weight="w") == 0
    assert value(frame, r2_score, (1, 1, 1), (3, 2, 3), weight="w") == pytest.approx(1 - 3 / (28 - 100 / 4))


def labels(frame, ys, ps):
    return frame("y int, p int", list(zip(ys, ps)))


def only(df):
    return df.first()[0]


def test_accuracy(frame):
    assert only(accuracy_score(labels(frame, (0, 1, 2), (0, 1, 2)), "y", "p")) == 1
    df = labels(frame, (0, 1, 1, 0), (0, 1, 0, 0))
    assert only(accuracy_score(df, "y", "p")) == 0.75 and only(accuracy_score(df, "y", "p", normalize=False)) == 3
    assert only(accuracy_score(df.where("y > 9"), "y", "p")) == 0
    assert only(accuracy_score(frame("y double, p double", [(NAN, NAN), (1.0, 1.0)]), "y", "p")) == 0.5


def test_confusion_matrix(frame):
    df = labels(frame, (0, 1, 0, 1, 0), (0, 1, 1, 1, 0))
    got = {(r.actual, r.predicted): r.n for r in confusion_matrix(df, "y", "p").collect()}
    assert got == {(0, 0): 2, (0, 1): 1, (1, 0): 0, (1, 1): 2}
    got = {(r.actual, r.predicted): r.n for r in confusion_matrix(df, "y", "p", [1, 5]).collect()}
    assert got == {(1, 1): 2, (1, 5): 0, (5, 1): 0, (5, 5): 0}


def test_averages(frame):
    df = labels(frame, (0, 0, 1, 2), (0, 1, 1, 1))
    assert only(precision_score(df, "y", "p", "macro")) == pytest.approx(4 / 9)
    assert only(recall_score(df, "y", "p", "macro")) == pytest.approx(1 / 2)
    assert only(f1_score(df, "y", "p", "macro")) == pytest.approx(8 / 17)
    for f in (precision_score, recall_score, f1_score):
        assert only(f(df, "y", "p", "micro")) == pytest.approx(0.5)
        with pytest.raises(ValueError):
            f(df, "y", "p", "other")
    assert only(f1_score(labels(frame, (0, 1, 0, 1), (0, 1, 0, 1)), "y", "p")) == 1
    assert only(precision_score(df, "y", "p", positive=1)) == pytest.approx(1 / 3)
    for f in (precision_score, recall_score, f1_score):
        assert only(f(df, "y", "p", positive=9)) == 0
        assert only(f(df.where("y > 9"), "y", "p", "macro")) == 0


def test_log_loss(frame):
    df = frame("y int, q array<double>", [(0, [0.5, 0.5]), (1, [0.25, 0.75])])
    assert only(log_loss(df, "y", "q")) == pytest.approx((-math.log(0.5) - math.log(0.75)) / 2)
    assert only(log_loss(frame("y int, q array<double>", [(5, [0.5, 0.5])]), "y", "q")) == pytest.approx(-math.log(1e-15), abs=1e-4)
    assert only(log_loss(frame("y int, q array<double>", [(0, [0.0]), (0, [1.0])]), "y", "q")) == pytest.approx(-math.log(1e-15) / 2, abs=1e-4)
    assert only(log_loss(df.where("y > 9"), "y", "q")) == 0


def test_vector_expressions(frame):
    df = frame("x array<double>, z array<double>, v double", [([0.0, math.log(3)], [3.0, 4.0 + math.log(3)], 0.0)])
    r = df.select(softmax("x").alias("s"), log_logistic("v").alias("l"), euclidean_distance("x", "z").alias("e"), row_norms("z", squared=True).alias("n"), dot("z", [2.0]).alias("d"), norm(F.array().cast("array<double>"), "max").alias("m")).first()
    assert r.s == pytest.approx([0.25, 0.75]) and r.l == pytest.approx(-math.log(2)) and r.e == pytest.approx(5) and r.d == pytest.approx(6) and r.m == 0
    far = frame("v double", [(800.0,), (-800.0,)]).select(log_logistic("v").alias("l")).collect()
    assert [x.l for x in far] == pytest.approx([0, -800])
    assert frame("x array<double>", [([1000.0, 1000.0],)]).select(softmax("x").alias("s")).first().s == [0.5, 0.5]


@given(st.integers(1, 6), st.integers(0, 10_000))
@settings(max_examples=40, deadline=None)
def test_dense_linear_algebra(n, seed):
    rng = np.random.default_rng(seed)
    x, b = rng.normal(size=(n + 3, n)), rng.normal(size=n)
    a = add_diagonal(x.T @ x, 0.1)
    lower = cholesky(a)
    assert np.allclose(lower @ lower.T, a) and np.allclose(np.triu(lower, 1), 0)
    assert np.allclose(forward_substitution(lower, b), np.linalg.solve(lower, b))
    assert np.allclose(back_substitution(lower.T, b), np.linalg.solve(lower.T, b))
    assert np.allclose(a @ cholesky_solve(a, b), b)


def test_singular_systems_take_least_squares():
    assert np.allclose(cholesky([[0.0, 0.0], [0.0, 4.0]]), [[0, 0], [0, 2]])
    assert np.allclose(cholesky_solve([[1.0, 1.0], [1.0, 1.0]], [2.0, 2.0]), [1, 1])
    assert np.allclose(cholesky([[-1.0]]), [[0]])


def test_long_matrices(frame):
    a = frame("i long, j long, v double", [(0, 0, 1.0), (0, 1, 0.0), (1, 0, 2.0), (1, 1, 3.0)])
    b = frame("i long, j long, v double", [(0, 0, 5.0), (1, 0, NAN)])
    got = {(r.i, r.j): r.v for r in matrices.matmul(a, b).collect()}
    assert got[0, 0] == 5 and math.isnan(got[1, 0])
    assert {(r.i, r.j): r.v for r in matrices.gram(a).collect()} == {(0, 0): 5.0, (0, 1): 6.0, (1, 0): 6.0, (1, 1): 9.0}
    assert matrices.matmul(a.where("i > 9"), b).count() == 0 == matrices.transpose(a.where("i > 9")).count()
    assert {(r.i, r.j): r.v for r in matrices.add_diagonal(a, 1.0).collect()}[1, 1] == 4
    assert [r.v for r in matrices.times_vector(a, frame("i long, y double", [(0, 1.0), (1, 10.0)])).orderBy("j").collect()] == [21, 30]


def test_targets(frame):
    def kind(*ys):
        return only(type_of_target(frame("y double", [(float(y),) for y in ys]), "y"))

    assert [kind(1, 1), kind(0, 1, 2), kind(0.5), kind(NAN, 1), kind(float("inf")), kind()] == ["binary", "multiclass", "continuous", "continuous", "continuous", "binary"]
    df = frame("y int", [(3,), (1,), (3,)])
    assert [r.label for r in unique_labels((df, "y"), (frame("y int", [(2,)]), "y")).collect()] == [1, 2, 3]
    assert only(is_binary_classification(df, "y")) and only(class_count(df, "y")) == 2 and not is_multilabel(df, "y")
    check_classification_targets(df, "y")
    with pytest.raises(ValueError):
        check_classification_targets(frame("y double", [(0.5,)]), "y")


def test_weights(frame):
    df = frame("y int", [(0,), (0,), (0,), (1,)])
    assert {r["class"]: r.weight for r in compute_class_weight("balanced", [0, 1], df, "y").collect()} == pytest.approx({0: 2 / 3, 1: 2})
    assert {r["class"]: r.weight for r in compute_class_weight("balanced", [1], df, "y").collect()} == pytest.approx({1: 4})
    assert sorted(r.weight for r in compute_sample_weight("balanced", df, "y").collect()) == pytest.approx([2 / 3] * 3 + [2])
    assert sorted(r.weight for r in compute_sample_weight({0: 1, 1: 5}, df, "y").collect()) == [1, 1, 1, 5]
    for call in (lambda: compute_class_weight("balanced", [0, 7], df, "y"), lambda: compute_class_weight({0: 1}, [0, 1], df, "y"), lambda: compute_sample_weight({0: 1}, df, "y"), lambda: compute_class_weight("other", [0], df, "y"), lambda: compute_sample_weight("other", df, "y")):
        with pytest.raises(ValueError):
            call()


def test_validation(frame):
    df = frame("x array<double>, a double, y int", [([1.0, 2.0], 1.0, 1), ([NAN, 2.0], 2.0, 0)])
    assert check_array(df, "x") is df and check_xy(df, ["a"], "y") is df and num_features(df, "x") == 2 and num_features(df.where("y > 9"), "x") == 0
    check_features_consistency(df, df, "x", ["a", "a"])
    bad = [lambda: check_array(df, "x", min_samples=3), lambda: check_array(df, ["a"], min_features=2), lambda: check_array(df.where("y > 9"), "x"), lambda: check_xy(df, "x", "none"), lambda: check_features_consistency(df, df, "x", ["a"]),
           lambda: check_array(frame("x array<double>", [([1.0],), ([1.0, 2.0],)]), "x"), lambda: check_array(frame("x array<double>", [(None,)]), "x"), lambda: check_array(frame("x array<double>", [([None],)]), "x"),
           lambda: check_xy(frame("a double, y int", [(1.0, None)]), ["a"], "y"), lambda: sample_weight(df, "none")]
    for call in bad:
        with pytest.raises(ValueError):
            call()
    assert frame("x array<double>", [([1.9, -1.9],)]).select(as_integers("x").alias("v")).first().v == [1, -1]
    with pytest.raises(Exception, match="OVERFLOW"):
        frame("x array<double>", [([3e9],)]).select(as_integers("x").alias("v")).collect()


@given(st.lists(st.tuples(st.floats(-1e3, 1e3), st.floats(-1e3, 1e3)), min_size=2, max_size=20))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_one_pass_holds_all_metrics(frame, rows):
    y, p = np.array(rows).T
    df = frame("y double, p double", [tuple(map(float, r)) for r in rows])
    r = df.agg(mean_squared_error("y", "p").alias("a"), mean_absolute_error("y", "p").alias("b"), r2_score("y", "p").alias("c")).first()
    assert r.a == pytest.approx(np.mean((y - p) ** 2)) and r.b == pytest.approx(np.mean(np.abs(y - p)))
    total = ((y - y.mean()) ** 2).sum()
    if total > 1e-3:
        assert r.c == pytest.approx(1 - ((y - p) ** 2).sum() / total, rel=1e-6, abs=1e-6)
