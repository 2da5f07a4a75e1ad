import numpy as np
import pytest

from tessara import KFold, LabelEncoder, LinearRegression, MinMaxScaler, Normalizer, NotFittedError, Ridge, StandardScaler, StratifiedKFold, check_is_fitted, clone, train_test_split
from tessara.base import ClassifierMixin, ClusterMixin, Estimator
from tessara.operators.linear_model import coefficients


def xy(frame, xs, ys):
    xs = [x if isinstance(x, tuple) else (x,) for x in xs]
    names = [f"x{k}" for k in range(len(xs[0]))]
    df = frame("id long, " + ", ".join(f"{n} double" for n in names) + ", y double", [(i, *map(float, x), float(y)) for i, (x, y) in enumerate(zip(xs, ys))])
    return df, names


@pytest.mark.parametrize(("xs", "ys", "intercept", "coef", "b"), [((1, 2, 3, 4, 5), (2, 4, 6, 8, 10), True, 2, 0), ((0, 1, 2), (1, 3, 5), True, 2, 1), ((1, 2, 3), (3, 6, 9), False, 3, 0)])
def test_ols_exact(frame, xs, ys, intercept, coef, b):
    df, names = xy(frame, xs, ys)
    m = LinearRegression(names, "y", fit_intercept=intercept).fit(df)
    assert m.coef_[0] == pytest.approx(coef, abs=1e-6)
    assert m.intercept_ == pytest.approx(b, abs=1e-6)
    if not intercept:
        assert m.intercept_ == 0
    assert m.rank_ == 1


def test_ols_predicts_and_scores(frame):
    df, names = xy(frame, (1, 2), (1, 2))
    m = LinearRegression(names, "y").fit(df)
    assert m.predict(xy(frame, (3,), (0,))[0]).first()["prediction"] == pytest.approx(3, abs=1e-4)
    df, names = xy(frame, [(1, 2), (2, 1), (3, 3), (4, 2)], (5, 4, 9, 8))
    m = LinearRegression(names, "y", fit_intercept=False).fit(df)
    assert m.predict(df).orderBy("id").first()["prediction"] == pytest.approx(5, abs=0.1)
    df, names = xy(frame, (1, 2, 3, 4), (2, 4, 6, 8))
    assert LinearRegression(names, "y").fit(df).score(df) == pytest.approx(1, abs=5e-6)


def test_collinear_features_are_judged_by_r2(frame):
    df, names = xy(frame, [(i, 2 * i) for i in range(20)], [3 * i + 1 for i in range(20)])
    assert LinearRegression(names, "y").fit(df).score(df) > 0.999
    assert Ridge(names, "y", alpha=0.0).fit(df).score(df) > 0.999
    far, _ = xy(frame, [(1e6 * i, 2e6 * i) for i in range(20)], [3 * i + 1 for i in range(20)])
    assert LinearRegression(names, "y").fit(far).score(far) > 0.999


def test_ridge(frame):
    df, names = xy(frame, (1, 2, 3, 4, 5), (2, 4, 6, 8, 10))
    m = Ridge(names, "y", alpha=1e-4).fit(df)
    assert m.coef_[0] == pytest.approx(2, abs=0.01) and m.n_iter_ == 1
    df, names = xy(frame, [(1, 0), (0, 1), (1, 1)], (2, 3, 5))
    small, large = (np.linalg.norm(Ridge(names, "y", alpha=a).fit(df).coef_) for a in (0.001, 100))
    assert large < small
    df, names = xy(frame, (1, 2, 3), (1, 2, 3))
    assert Ridge(names, "y", alpha=0.001).fit(df).predict(xy(frame, (4,), (0,))[0]).first()["prediction"] == pytest.approx(4, abs=0.1)
    df, names = xy(frame, range(20), [2 * i + 1 for i in range(20)])
    assert Ridge(names, "y", alpha=0.001).fit(df).score(df) > 0.99


@pytest.mark.parametrize("intercept", [True, False])
@pytest.mark.parametrize("p", [3, 12])
def test_narrow_and_wide_fits_agree_with_numpy(spark, frame, p, intercept):
    rng = np.random.default_rng(p)
    x, y = rng.normal(size=(200, p)) + 3, rng.normal(size=200)
    names = [f"x{k}" for k in range(p)]
    df = frame(", ".join(f"{n} double" for n in names) + ", y double", [(*map(float, r), float(v)) for r, v in zip(x, y)])
    a, b = (x - x.mean(0), y - y.mean()) if intercept else (x, y)
    want = np.linalg.solve(a.T @ a + 2.5 * np.eye(p), a.T @ b)
    m = Ridge(names, "y", alpha=2.5, fit_intercept=intercept).fit(df)
    assert np.allclose(m.coef_, want, atol=1e-9)
    arrays = df.selectExpr(f"array({','.join(names)}) AS x", "y")
    n = Ridge("x", "y", alpha=2.5, fit_intercept=intercept).fit(arrays)
    assert np.allclose(n.coef_, want, atol=1e-9) and n.intercept_ == pytest.approx(m.intercept_, abs=1e-9)
    assert n.score(arrays) == pytest.approx(m.score(df), abs=1e-9)
    assert [r["term"] for r in coefficients(m, df).collect()] == [*names, "intercept"]


def test_ridge_agrees_with_the_library_solver(spark, frame):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression as Other
    from pyspark.sql import functions as F

    df, names = xy(frame, [(i % 7, (i * i) % 11) for i in range(60)], [3 * (i % 7) - (i * i) % 11 + (i % 3) for i in range(60)])
    n, spread = df.agg(F.count("y"), F.stddev_pop("y")).first()
    other = Other(featuresCol="x", labelCol="y", solver="normal", standardization=False, elasticNetParam=0.0, regParam=4.0 * spread / n).fit(VectorAssembler(inputCols=names, outputCol="x").transform(df))
    assert np.allclose(Ridge(names, "y", alpha=4.0).fit(df).coef_, other.coefficients.toArray(), atol=1e-9)


def test_refusals(frame):
    df, names = xy(frame, (1, 2, 3), (1, 2, 3))
    for m in (LinearRegression(names, "y"), Ridge(names, "y")):
        with pytest.raises(NotFittedError):
            m.predict(df)
    with pytest.raises(NotFittedError):
        StandardScaler(names).transform(df)
    with pytest.raises(ValueError):
        LinearRegression(names, "y", positive=True).fit(df)
    with pytest.raises(ValueError):
        LinearRegression(names, "y").fit(df.where("id < 0"))
    with pytest.raises(ValueError):
        LinearRegression(["nothing"], "y").fit(df)
    m = LinearRegression(names, "y").fit(df)
    m.features = ["x0", "x0"]
    with pytest.raises(ValueError):
        m.predict(df)
    for bad in ({"train_size": 0.5}, {"stratify": "y"}):
        with pytest.raises(ValueError):
            train_test_split(df, "id", **bad)
    with pytest.raises(ValueError):
        train_test_split(df, "id", test_size=1.0)


def values(df, *names):
    return [tuple(r) for r in df.orderBy("id").select(*names).collect()]


def test_standard_scaler(frame):
    df = frame("id long, a double, b double, c double", [(0, 1.0, 2.0, 7.0), (1, 3.0, 4.0, 7.0), (2, 5.0, 6.0, 7.0)])
    s = StandardScaler(["a", "b", "c"]).fit(df)
    assert s.mean_ == pytest.approx([3, 4, 7], abs=1e-10) and s.scale_ == pytest.approx([2, 2, 1]) and s.n_samples_seen_ == 3
    out = s.transform(df)
    assert values(out, "a", "c") == [(-1.0, 0.0), (0.0, 0.0), (1.0, 0.0)]
    assert np.allclose(values(s.inverse_transform(out), "a", "b", "c"), values(df, "a", "b", "c"), atol=1e-8)
    assert values(StandardScaler(["c"], with_mean=False).fit_transform(df), "c") == [(7.0,)] * 3
    one = frame("id long, a double", [(0, 5.0)])
    s = StandardScaler(["a"]).fit(one)
    assert (s.var_, s.scale_) == ([0.0], [1.0]) and values(s.transform(one), "a") == [(0.0,)]


def test_scalers_take_array_columns(frame):
    df = frame("id long, x array<double>", [(0, [1.0, 7.0]), (1, [3.0, 7.0]), (2, [5.0, 7.0])])
    assert values(StandardScaler("x").fit_transform(df), "x") == [([-1.0, 0.0],), ([0.0, 0.0],), ([1.0, 0.0],)]
    assert values(MinMaxScaler("x").fit_transform(df), "x") == [([0.0, 0.0],), ([0.5, 0.0],), ([1.0, 0.0],)]
    with pytest.raises(Exception, match="does not have 2 features"):
        StandardScaler("x").fit(df).transform(frame("id long, x array<double>", [(0, [1.0])])).collect()
    with pytest.raises(ValueError):
        StandardScaler("x").fit(frame("id long, x array<double>", [(0, [1.0]), (1, [1.0, 2.0])]))


def test_minmax_scaler(frame):
    df = frame("id long, a double, b double", [(0, 0.0, 2.0), (1, 5.0, 4.0), (2, 10.0, 6.0)])
    assert values(MinMaxScaler(["a"]).fit_transform(df), "a") == [(0.0,), (0.5,), (1.0,)]
    s = MinMaxScaler(["a", "b"], (-1.0, 1.0)).fit(df)
    assert values(s.transform(df), "a") == [(-1.0,), (0.0,), (1.0,)]
    assert np.allclose(values(s.inverse_transform(s.transform(df)), "a", "b"), values(df, "a", "b"), atol=1e-8)
    same = frame("id long, a double", [(0, 7.0), (1, 7.0)])
    s = MinMaxScaler(["a"]).fit(same)
    assert values(s.transform(same), "a") == [(0.0,)] * 2 and values(s.inverse_transform(s.transform(same)), "a") == [(0.0,)] * 2
    nan = float("nan")
    s = MinMaxScaler(["a"], clip=True).fit(frame("id long, a double", [(0, 0.0), (1, 10.0), (2, nan)]))
    got = values(s.transform(frame("id long, a double", [(0, -5.0), (1, 5.0), (2, 15.0), (3, nan)])), "a")
    assert got[:3] == [(0.0,), (0.5,), (1.0,)] and np.isnan(got[3][0])
    with pytest.raises(ValueError):
        MinMaxScaler(["a"], (1.0, 1.0)).fit(df)


def test_label_encoder(frame):
    def df(*ys):
        return frame("id long, y int", list(enumerate(ys)))

    assert values(LabelEncoder("y").fit_transform(df(3, 1, 2, 1, 3)), "y") == [(2,), (0,), (1,), (0,), (2,)]
    e = LabelEncoder("y").fit(df(10, 20, 30))
    assert values(e.inverse_transform(e.transform(df(10, 20, 30))), "y") == [(10,), (20,), (30,)]
    assert values(LabelEncoder("y", "code").fit(df(1, 10, 2)).transform(df(10, 2)), "y", "code") == [(10, 2), (2, 1)]
    with pytest.raises(Exception, match="unseen label: 4"):
        LabelEncoder("y").fit(df(1, 2, 3)).transform(df(4)).collect()
    with pytest.raises(Exception, match="no such code: 9"):
        e.inverse_transform(df(9)).collect()
    with pytest.raises(ValueError):
        LabelEncoder("y").fit(frame("id long, y double", [(0, 0.5)]))


@pytest.mark.parametrize(("row", "kind", "want"), [((3.0, 4.0), "l2", (0.6, 0.8)), ((1.0, 3.0), "l1", (0.25, 0.75)), ((3.0, -4.0), "max", (0.75, -1.0)), ((0.0, 0.0), "l2", (0.0, 0.0))])
def test_normalizer(frame, row, kind, want):
    df = frame("id long, a double, b double", [(0, *row)])
    assert values(Normalizer(["a", "b"], kind).transform(df), "a", "b")[0] == pytest.approx(want, abs=1e-8)
    assert values(Normalizer(["a", "b"], kind, output="x").fit_transform(df), "x")[0][0] == pytest.approx(want, abs=1e-8)


def test_unknown_norm(frame):
    with pytest.raises(ValueError):
        Normalizer(["a"], "l3").transform(frame("a double", [(1.0,)]))


def rows(spark, n):
    return spark.range(n).withColumnRenamed("id", "k")


def test_split_sizes_and_seeds(spark):
    train, test = train_test_split(rows(spark, 100), "k", 0.2)
    a, b = {r.k for r in train.collect()}, {r.k for r in test.collect()}
    assert (len(a), len(b)) == (80, 20) and not a & b and a | b == set(range(100))
    again = {r.k for r in train_test_split(rows(spark, 100).repartition(7), "k", 0.2)[1].collect()}
    assert again == b and {r.k for r in train_test_split(rows(spark, 100), "k", 0.2, random_state=1)[1].collect()} != b
    train, test = train_test_split(rows(spark, 3), "k", 0.01)
    assert (train.count(), test.count()) == (2, 1)
    assert [r.k for r in train_test_split(rows(spark, 4), "k", shuffle=False)[1].collect()] == [3]


@pytest.mark.parametrize("shuffle", [False, True])
@pytest.mark.parametrize(("n", "k", "sizes"), [(10, 5, [2] * 5), (9, 3, [3] * 3), (11, 3, [4, 4, 3])])
def test_kfold(spark, n, k, sizes, shuffle):
    folds = list(KFold("k", k, shuffle).split(rows(spark, n)))
    tests = [[r.k for r in t.collect()] for _, t in folds]
    assert [len(t) for t in tests] == sizes and sorted(x for t in tests for x in t) == list(range(n))
    assert all(train.count() == n - len(t) for (train, _), t in zip(folds, tests)) and KFold("k", k).get_n_splits() == k


def test_kfold_refuses_at_the_first_fold(spark):
    folds = KFold("k", 5).split(rows(spark, 3))
    with pytest.raises(ValueError):
        next(folds)


def test_stratified_kfold(frame):
    df = frame("k long, y int", list(enumerate([0, 0, 0, 1, 1])))
    assert [r.fold for r in StratifiedKFold("k", "y", 2).assign(df).orderBy("k").collect()] == [0, 1, 0, 0, 1]
    shuffled = StratifiedKFold("k", "y", 2, shuffle=True).assign(df).groupBy("y", "fold").count().collect()
    assert {(r["y"], r["fold"]): r["count"] for r in shuffled} == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    assert sum(t.count() for _, t in StratifiedKFold("k", "y", 2).split(df)) == 5


class Dummy(Estimator):
    def __init__(self, alpha=1.0, beta="hello", inner=None):
        self.alpha, self.beta, self.inner = alpha, beta, inner


def test_protocol():
    d = Dummy(2.0)
    assert d.get_params() == {"alpha": 2.0, "beta": "hello", "inner": None}
    assert d.set_params(alpha=5.0) is d and d.alpha == 5.0
    with pytest.raises(ValueError):
        d.set_params(gamma=1)
    with pytest.raises(NotFittedError):
        check_is_fitted(d)
    d.fitted_ = True
    check_is_fitted(d)
    with pytest.raises(NotFittedError):
        check_is_fitted(d, "other_")
    outer = Dummy(3.0, "foo", d)
    copy = clone(outer)
    assert copy is not outer and copy.beta == "foo" and copy.inner is not d and not hasattr(copy.inner, "fitted_")
    assert outer.get_params()["inner"] == d.get_params()
    assert isinstance(NotFittedError(), ValueError) and NotFittedError.__name__ == "NotFittedError"


def test_mixins(frame):
    from pyspark.sql import functions as F

    class Majority(ClassifierMixin, Estimator):
        target = "y"

        def predict(self, df):
            return df.withColumn("prediction", F.lit(1))

    class All(ClusterMixin, Estimator):
        def fit(self, df):
            return self

    df = frame("y int", [(1,), (1,), (0,), (1,)])
    assert Majority().score(df) == 0.75
    assert {r.cluster for r in All().fit_predict(df).collect()} == {0}
