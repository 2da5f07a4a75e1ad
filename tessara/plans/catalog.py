"""Named queries over the test tables, each with the same query in DuckDB's SQL.

Values are rounded alike in both by ``floor(x * 10^d + 1/2) / 10^d``, as the
engines' own rounding functions differ on ties.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors
from ..base import ClassifierMixin, ClusterMixin, Estimator, check_is_fitted, clone
from ..functions.linalg import back_substitution, cholesky, forward_substitution
from ..functions.vectors import array_of, dot, euclidean_distance, log_logistic, row_norms, softmax
from ..operators.classification import accuracy_score, confusion_matrix, f1_score, log_loss, precision_score, recall_score
from ..operators.linear_model import LinearRegression, Ridge, coefficients
from ..operators.model_selection import KFold, StratifiedKFold, assign_split, cross_validated_r2
from ..operators.preprocessing import LabelEncoder, MinMaxScaler, Normalizer, StandardScaler
from ..operators.regression import explained_variance_score, mean_absolute_error, mean_absolute_percentage_error, mean_squared_error, r2_score
from ..operators.targets import check_classification_targets, class_count, compute_class_weight, compute_sample_weight, is_binary_classification, is_multilabel, type_of_target, unique_labels
from ..operators.validation import as_doubles, as_integers, check_counts, check_features_consistency, num_features, sample_weight
from ..sources import read_table
from . import matrices
from .moments import moments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def register(name: str, f: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = f, sql


def rounded(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def _r(expression: str, digits: int = 6) -> str:
    return f"floor(({expression})*1e{digits}+5e-1)/1e{digits}"


# Linear models: a plane over two features has a closed form, in SQL too.

_PLANE = """WITH m AS (SELECT avg(x1) AS a1, avg(x2) AS a2, avg(y) AS ay, var_pop(x1)*count(*)+{alpha} AS g11, var_pop(x2)*count(*)+{alpha} AS g22,
 covar_pop(x1,x2)*count(*) AS g12, covar_pop(x1,y)*count(*) AS c1, covar_pop(x2,y)*count(*) AS c2 FROM t),
 b AS (SELECT (c1*g22-c2*g12)/(g11*g22-g12*g12) AS b1, (c2*g11-c1*g12)/(g11*g22-g12*g12) AS b2, a1, a2, ay FROM m),
 k AS (SELECT b1, b2, ay-b1*a1-b2*a2 AS b0 FROM b)"""
_PART = "t AS (SELECT p_partkey, p_partkey::DOUBLE AS x1, p_size::DOUBLE AS x2, p_retailprice AS y FROM part)"
_LINE = "t AS (SELECT l_quantity AS x1, l_discount AS x2, l_extendedprice AS y FROM lineitem)"


def _plane(table: str, alpha: float) -> str:
    return _PLANE.format(alpha=f"{alpha:e}").replace("WITH m", f"WITH {table}, m")


def _terms(a: str, b: str, digits: int) -> str:
    return f"SELECT '{a}' AS term, {_r('b1', digits)} AS coef FROM k UNION ALL SELECT '{b}', {_r('b2', digits)} FROM k UNION ALL SELECT 'intercept', {_r('b0', digits)} FROM k"


def _fitted(model, df: DataFrame, digits: int) -> DataFrame:
    return coefficients(model.fit(df), df).select("term", rounded("coef", digits).alias("coef"))


def _part(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")


def _line(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")


PART, LINE = (["p_partkey", "p_size"], "p_retailprice"), (["l_quantity", "l_discount"], "l_extendedprice")
_SCORE = "SELECT " + _r("1-sum((y-(b0+b1*x1+b2*x2))*(y-(b0+b1*x1+b2*x2)))/(count(*)*var_pop(y))") + " AS r2 FROM t, k"


@query(_plane(_PART, 1e-12) + " " + _terms("p_partkey", "p_size", 6))
def ols_fit(spark, sf_dir):
    return _fitted(LinearRegression(*PART), _part(spark, sf_dir), 6)


@query(_plane(_PART, 1e-12) + f" SELECT p_partkey, {_r('b0+b1*x1+b2*x2', 4)} AS prediction FROM t, k")
def ols_predict(spark, sf_dir):
    df = _part(spark, sf_dir)
    return LinearRegression(*PART).fit(df).predict(df).select("p_partkey", rounded("prediction", 4).alias("prediction"))


@query(_plane(_PART, 1e-12) + " " + _SCORE)
def ols_score(spark, sf_dir):
    df = _part(spark, sf_dir)
    return LinearRegression(*PART).fit(df).predict(df).agg(rounded(r2_score("p_retailprice", "prediction")).alias("r2"))


@query(f"SELECT 'l_quantity' AS term, {_r('regr_slope(l_extendedprice,l_quantity)', 4)} AS coef FROM lineitem UNION ALL SELECT 'intercept', {_r('regr_intercept(l_extendedprice,l_quantity)', 4)} FROM lineitem")
def ols_simple(spark, sf_dir):
    return _fitted(LinearRegression(["l_quantity"], "l_extendedprice"), _line(spark, sf_dir), 4)


@query(f"SELECT 'l_quantity' AS term, {_r('sum(l_quantity*l_extendedprice)/sum(l_quantity*l_quantity)', 4)} AS coef FROM lineitem UNION ALL SELECT 'intercept', 0e0")
def ols_no_intercept(spark, sf_dir):
    return _fitted(LinearRegression(["l_quantity"], "l_extendedprice", fit_intercept=False), _line(spark, sf_dir), 4)


def _ridge(alpha: float) -> Query:
    return lambda spark, sf_dir: _fitted(Ridge(*LINE, alpha=alpha), _line(spark, sf_dir), 3)


for _alpha in (1, 100):
    register(f"ridge_fit_a{_alpha}", _ridge(float(_alpha)), _plane(_LINE, float(_alpha)) + " " + _terms("l_quantity", "l_discount", 3))


@query(_plane(_PART, 10.0) + f" SELECT p_partkey, {_r('b0+b1*x1+b2*x2', 4)} AS prediction FROM t, k")
def ridge_predict(spark, sf_dir):
    df = _part(spark, sf_dir)
    return Ridge(*PART, alpha=10.0).fit(df).predict(df).select("p_partkey", rounded("prediction", 4).alias("prediction"))


@query(_plane(_LINE, 1.0) + " " + _SCORE)
def ridge_score(spark, sf_dir):
    df = _line(spark, sf_dir)
    return Ridge(*LINE).fit(df).predict(df).agg(rounded(r2_score("l_extendedprice", "prediction")).alias("r2"))


@query(
    "WITH s AS (SELECT avg(p_partkey) AS m1, stddev_samp(p_partkey) AS s1, avg(p_size) AS m2, stddev_samp(p_size) AS s2 FROM part),"
    " t AS (SELECT (p_partkey-m1)/s1 AS x1, (p_size-m2)/s2 AS x2, p_retailprice AS y FROM part, s), " + _PLANE.format(alpha="1e0").removeprefix("WITH ") + " " + _terms("p_partkey", "p_size", 5)
)
def scale_then_ridge(spark, sf_dir):
    return _fitted(Ridge(*PART), StandardScaler(PART[0]).fit_transform(_part(spark, sf_dir)), 5)


# Scalers.


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", "value", F.lit(7.0).alias("seven"))


def _scaled(df: DataFrame) -> DataFrame:
    return df.select("event_id", rounded("value").alias("value"), rounded("seven").alias("seven"))


_STATS = "WITH e AS (SELECT event_id, value, 7e0 AS seven FROM events), s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi FROM e)"
COLUMNS = ["value", "seven"]


@query(f"{_STATS} SELECT event_id, {_r('(value-m)/sd')} AS value, 0e0 AS seven FROM e, s")
def standard_scale(spark, sf_dir):
    return _scaled(StandardScaler(COLUMNS).fit_transform(_events(spark, sf_dir)))


@query(f"{_STATS} SELECT event_id, {_r('value/sd')} AS value, 7e0 AS seven FROM e, s")
def standard_no_mean(spark, sf_dir):
    return _scaled(StandardScaler(COLUMNS, with_mean=False).fit_transform(_events(spark, sf_dir)))


@query(f"{_STATS} SELECT event_id, {_r('value-m')} AS value, 0e0 AS seven FROM e, s")
def standard_no_std(spark, sf_dir):
    return _scaled(StandardScaler(COLUMNS, with_std=False).fit_transform(_events(spark, sf_dir)))


@query(f"SELECT event_id, {_r('value', 4)} AS value, 7e0 AS seven FROM events")
def standard_inverse(spark, sf_dir):
    scaler, df = StandardScaler(COLUMNS), _events(spark, sf_dir)
    return scaler.inverse_transform(scaler.fit_transform(df)).select("event_id", rounded("value", 4).alias("value"), rounded("seven").alias("seven"))


@query(
    "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), s AS (SELECT pos, avg(v) AS m, stddev_samp(v) AS sd FROM x GROUP BY pos)"
    f" SELECT vec_id, pos::INTEGER AS pos, {_r('(v-m)/sd')} AS v FROM x JOIN s USING (pos)"
)
def standard_scale_array(spark, sf_dir):
    df = StandardScaler("embedding").fit_transform(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return df.select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", "pos", rounded("v").alias("v"))


@query(f"{_STATS} SELECT event_id, {_r('(value-lo)/(hi-lo)')} AS value, 0e0 AS seven FROM e, s")
def minmax_scale(spark, sf_dir):
    return _scaled(MinMaxScaler(COLUMNS).fit_transform(_events(spark, sf_dir)))


@query(f"{_STATS} SELECT event_id, {_r('-1+2*(value-lo)/(hi-lo)')} AS value, -1e0 AS seven FROM e, s")
def minmax_range_neg1_1(spark, sf_dir):
    return _scaled(MinMaxScaler(COLUMNS, (-1.0, 1.0)).fit_transform(_events(spark, sf_dir)))


@query(f"WITH f AS (SELECT min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part) SELECT event_id, {_r('least(1e0, greatest(0e0, (value-lo)/(hi-lo)))')} AS value, 0e0 AS seven FROM events, f")
def minmax_clip(spark, sf_dir):
    other = read_table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("value"), F.lit(7.0).alias("seven"))
    return _scaled(MinMaxScaler(COLUMNS, clip=True).fit(other).transform(_events(spark, sf_dir)))


@query(f"SELECT event_id, {_r('value', 4)} AS value, 0e0 AS seven FROM events")
def minmax_inverse(spark, sf_dir):
    scaler, df = MinMaxScaler(COLUMNS), _events(spark, sf_dir)
    return scaler.inverse_transform(scaler.fit_transform(df)).select("event_id", rounded("value", 4).alias("value"), rounded("seven").alias("seven"))


# Encoder and normaliser.


def _customers(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") * 10 - 50).alias("label"))


@query("SELECT c_custkey, c_nationkey*10-50 AS label, (dense_rank() OVER (ORDER BY c_nationkey) - 1)::BIGINT AS code FROM customer")
def label_encode(spark, sf_dir):
    return LabelEncoder("label", "code").fit_transform(_customers(spark, sf_dir)).select("c_custkey", "label", F.col("code").cast("bigint").alias("code"))


@query("SELECT c_custkey, c_nationkey*10-50 AS label FROM customer")
def label_decode(spark, sf_dir):
    encoder = LabelEncoder("label")
    return encoder.inverse_transform(encoder.fit_transform(_customers(spark, sf_dir))).select("c_custkey", "label")


_NORMS = {"l1": "list_sum(list_transform(x, lambda v: abs(v)))", "l2": "sqrt(list_sum(list_transform(x, lambda v: v*v)))", "max": "list_max(list_transform(x, lambda v: abs(v)))"}


def _normalised(kind: str) -> Query:
    def run(spark, sf_dir):
        df = Normalizer("embedding", kind).transform(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
        return df.select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", "pos", rounded("v").alias("v"))

    return run


for _kind, _sql in _NORMS.items():
    register(f"normalize_{_kind}", _normalised(_kind), f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), n AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS pos, {_sql} AS n FROM e) SELECT vec_id, pos::INTEGER AS pos, {_r('v/n')} AS v FROM n")


@query(ORACLES["normalize_l1"])
def normalize_fit(spark, sf_dir):
    """fit() learns nothing, but gives the normaliser back."""
    df = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return Normalizer("embedding", "l1").fit(df).transform(df).select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", "pos", rounded("v").alias("v"))


@query(ORACLES["normalize_max"])
def normalize_fit_transform(spark, sf_dir):
    df = Normalizer("embedding", "max").fit_transform(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return df.select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", "pos", rounded("v").alias("v"))


@query(f"SELECT l_orderkey, {_r('l_quantity/n')} AS q, {_r('l_discount/n')} AS d, {_r('l_tax/n')} AS t FROM (SELECT *, sqrt(l_quantity*l_quantity+l_discount*l_discount+l_tax*l_tax) AS n FROM lineitem)")
def normalize_columns(spark, sf_dir):
    df = Normalizer(["l_quantity", "l_discount", "l_tax"]).transform(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax"))
    return df.select("l_orderkey", rounded("l_quantity").alias("q"), rounded(F.col("l_discount") + 0.0).alias("d"), rounded(F.col("l_tax") + 0.0).alias("t"))


# Regression metrics, with a formula for the prediction and the quantity as weight.

_PREDICTED = "WITH t AS (SELECT l_extendedprice AS y, 1000*l_quantity+20000*l_discount AS p, l_quantity AS w FROM lineitem)"


def _predictions(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (1000 * F.col("l_quantity") + 20000 * F.col("l_discount")).alias("p"), F.col("l_quantity").alias("w"))


_REGRESSION: dict[str, tuple[Callable[[], Column], str, int]] = {
    "mse": (lambda: mean_squared_error("y", "p"), "avg((y-p)*(y-p))", 2),
    "rmse": (lambda: mean_squared_error("y", "p", squared=False), "sqrt(avg((y-p)*(y-p)))", 4),
    "mae": (lambda: mean_absolute_error("y", "p"), "avg(abs(y-p))", 4),
    "r2": (lambda: r2_score("y", "p"), "1-sum((y-p)*(y-p))/(count(*)*var_pop(y))", 6),
    "mape": (lambda: mean_absolute_percentage_error("y", "p"), "sum(CASE WHEN y <> 0 THEN abs((y-p)/y) ELSE 0e0 END)/count(*)", 6),
    "explained_variance": (lambda: explained_variance_score("y", "p"), "1-var_pop(y-p)/var_pop(y)", 6),
    "mse_weighted": (lambda: mean_squared_error("y", "p", "w"), "sum(w*(y-p)*(y-p))/sum(w)", 2),
    "rmse_weighted": (lambda: mean_squared_error("y", "p", "w", squared=False), "sqrt(sum(w*(y-p)*(y-p))/sum(w))", 4),
    "mae_weighted": (lambda: mean_absolute_error("y", "p", "w"), "sum(w*abs(y-p))/sum(w)", 4),
    "r2_weighted": (lambda: r2_score("y", "p", "w"), "1-sum(w*(y-p)*(y-p))/(sum(w*y*y)-sum(w*y)*sum(w*y)/sum(w))", 6),
}


def _regression(name: str) -> Query:
    build, _, digits = _REGRESSION[name]
    return lambda spark, sf_dir: _predictions(spark, sf_dir).agg(rounded(build(), digits).alias(name))


for _name, (_, _sql, _digits) in _REGRESSION.items():
    register(_name, _regression(_name), f"{_PREDICTED} SELECT {_r(_sql, _digits)} AS {_name} FROM t")


@query(f"{_PREDICTED} SELECT " + ", ".join(f"{_r(sql, digits)} AS {name}" for name, (_, sql, digits) in _REGRESSION.items()) + " FROM t")
def regression_report(spark, sf_dir):
    """All of them from one pass over the rows."""
    return _predictions(spark, sf_dir).agg(*[rounded(build(), digits).alias(name) for name, (build, _, digits) in _REGRESSION.items()])


@query(f"WITH t AS (SELECT 1e9+l_extendedprice AS y, 1e9+1000*l_quantity+20000*l_discount AS p, l_quantity AS w FROM lineitem), m AS (SELECT sum(w*(y-1e9))/sum(w) AS m FROM t) SELECT {_r('1-sum(w*(y-p)*(y-p))/sum(w*(y-1e9-m)*(y-1e9-m))')} AS r2 FROM t, m")
def r2_weighted_far(spark, sf_dir):
    """Targets far from 0, where squares of them would cancel."""
    df = _predictions(spark, sf_dir).select((F.col("y") + 1e9).alias("y"), (F.col("p") + 1e9).alias("p"), "w")
    return df.agg(rounded(r2_score("y", "p", "w")).alias("r2"))


# Classification metrics: quality against toxic for two classes, embeddings' labels against vec_id % 10 for ten.


def _two(spark, sf_dir):
    return read_table(spark, sf_dir, "labels").select(F.col("quality").alias("y"), F.col("toxic").alias("p"))


def _ten(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select(F.col("label").alias("y"), (F.col("vec_id") % 10).cast("int").alias("p"))


_TWO = "t AS (SELECT quality AS y, toxic AS p FROM labels)"
_TEN = "t AS (SELECT label AS y, (vec_id % 10)::INTEGER AS p FROM embeddings)"
_CLASSES = (
    f"WITH {_TEN}, a AS (SELECT y AS c, count(*) AS n, count(*) FILTER (WHERE y=p) AS h FROM t GROUP BY y), b AS (SELECT p AS c, count(*) AS m FROM t GROUP BY p),"
    " k AS (SELECT avg(CASE WHEN coalesce(m, 0) > 0 THEN h/m::DOUBLE ELSE 0e0 END) AS pr, avg(h/n::DOUBLE) AS re FROM a LEFT JOIN b USING (c))"
)
_BINARY = f"WITH {_TWO}, k AS (SELECT count(*) FILTER (WHERE p=1 AND y=1)/count(*) FILTER (WHERE p=1)::DOUBLE AS pr, count(*) FILTER (WHERE p=1 AND y=1)/count(*) FILTER (WHERE y=1)::DOUBLE AS re FROM t)"
_MICRO = f"WITH {_TEN}, k AS (SELECT avg((y=p)::INTEGER) AS pr, avg((y=p)::INTEGER) AS re FROM t)"
_METRICS = {"precision": (precision_score, "pr"), "recall": (recall_score, "re"), "f1": (f1_score, "2*pr*re/(pr+re)")}


def _classified(name: str, average: str) -> Query:
    rows = _two if average == "binary" else _ten
    return lambda spark, sf_dir: _METRICS[name][0](rows(spark, sf_dir), "y", "p", average).select(rounded(name).alias(name))


for _name, (_, _sql) in _METRICS.items():
    for _average, _with in (("binary", _BINARY), ("macro", _CLASSES), ("micro", _MICRO)):
        register(f"{_name}_{_average}", _classified(_name, _average), f"{_with} SELECT {_r(_sql)} AS {_name} FROM k")


@query(f"WITH {_TWO} SELECT {_r('avg((y=p)::INTEGER)')} AS accuracy FROM t")
def accuracy(spark, sf_dir):
    return accuracy_score(_two(spark, sf_dir), "y", "p").select(rounded("accuracy").alias("accuracy"))


@query(f"WITH {_TWO} SELECT count(*) FILTER (WHERE y=p) AS accuracy FROM t")
def accuracy_count(spark, sf_dir):
    return accuracy_score(_two(spark, sf_dir), "y", "p", normalize=False)


_CELLS = " SELECT a.l AS actual, b.l AS predicted, (SELECT count(*) FROM t WHERE y=a.l AND p=b.l) AS n FROM l a, l b"


@query(f"WITH {_TEN}, l AS (SELECT y AS l FROM t UNION SELECT p FROM t)" + _CELLS)
def confusion(spark, sf_dir):
    return confusion_matrix(_ten(spark, sf_dir), "y", "p")


@query(f"WITH {_TEN}, l AS (SELECT unnest([7, 3, 99])::INTEGER AS l)" + _CELLS)
def confusion_labels(spark, sf_dir):
    return confusion_matrix(_ten(spark, sf_dir), "y", "p", [7, 3, 99])


@query(f"WITH {_TEN} SELECT y AS actual, p AS predicted, count(*) AS n FROM t GROUP BY y, p")
def confusion_sparse(spark, sf_dir):
    return confusion_matrix(_ten(spark, sf_dir), "y", "p", dense=False)


@query(
    "WITH e AS (SELECT label, list_transform(embedding[1:8]::DOUBLE[], lambda v: exp(v)) AS x FROM embeddings),"
    " p AS (SELECT CASE WHEN label % 3 = 0 AND label < 8 THEN x[label+1]/list_sum(x) ELSE 1e-15 END AS p FROM e)"
    f" SELECT {_r('avg(-ln(greatest(1e-15, least(1e0-1e-15, p))))')} AS log_loss FROM p"
)
def log_loss_odd_labels(spark, sf_dir):
    """Labels that are no whole numbers, NaN among them, have no place."""
    label = F.when(F.col("label") % 3 == 0, F.col("label").cast("double")).when(F.col("label") % 3 == 1, F.col("label") + 0.5).otherwise(F.lit(float("nan")))
    df = read_table(spark, sf_dir, "embeddings").select(label.alias("label"), softmax(F.slice(F.col("embedding"), 1, 8)).alias("proba"))
    return log_loss(df, "label", "proba").select(rounded("log_loss").alias("log_loss"))


@query(
    "WITH e AS (SELECT label, list_transform(embedding[1:8]::DOUBLE[], lambda v: exp(v)) AS x FROM embeddings), p AS (SELECT CASE WHEN label < 8 THEN x[label+1]/list_sum(x) ELSE 1e-15 END AS p FROM e)"
    f" SELECT {_r('avg(-ln(greatest(1e-15, least(1e0-1e-15, p))))')} AS log_loss FROM p"
)
def logarithmic_loss(spark, sf_dir):
    df = read_table(spark, sf_dir, "embeddings").select("label", softmax(F.slice(F.col("embedding"), 1, 8)).alias("proba"))
    return log_loss(df, "label", "proba").select(rounded("log_loss").alias("log_loss"))


# Splits. Orders by hash are those of md5('seed:key').


def _orders(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select("o_orderkey")


def _split_sql(order: str, size: str) -> str:
    return f"WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {order}) AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN k <= n - greatest(1, floor(n*{size}+5e-1)) THEN 'train' ELSE 'test' END AS part FROM r"


@query(_split_sql("md5('42:' || o_orderkey), o_orderkey", "2e-1"))
def split_shuffled(spark, sf_dir):
    return assign_split(_orders(spark, sf_dir), "o_orderkey", 0.2)


@query(_split_sql("o_orderkey", "25e-2"))
def split_ordered(spark, sf_dir):
    return assign_split(_orders(spark, sf_dir), "o_orderkey", shuffle=False)


@query("SELECT o_orderkey, (ntile(7) OVER (ORDER BY o_orderkey) - 1)::BIGINT AS fold FROM orders")
def kfold(spark, sf_dir):
    return KFold("o_orderkey", 7).assign(_orders(spark, sf_dir))


@query("SELECT o_orderkey, (ntile(5) OVER (ORDER BY md5('3:' || o_orderkey), o_orderkey) - 1)::BIGINT AS fold FROM orders")
def kfold_shuffled(spark, sf_dir):
    return KFold("o_orderkey", 5, shuffle=True, random_state=3).assign(_orders(spark, sf_dir))


@query("SELECT 7 AS n_splits")
def kfold_n_splits(spark, sf_dir):
    return spark.createDataFrame([(KFold("o_orderkey", 7).get_n_splits(),)], "n_splits int")


@query(
    "WITH f AS (SELECT c_custkey, ntile(3) OVER (ORDER BY c_custkey) - 1 AS fold FROM customer), k AS (SELECT unnest(range(3)) AS fold)"
    " SELECT k.fold::INTEGER AS fold, 'test' AS side, count(*) AS n, min(c_custkey) AS lo, max(c_custkey) AS hi FROM f JOIN k ON f.fold = k.fold GROUP BY k.fold"
    " UNION ALL SELECT k.fold::INTEGER, 'train', count(*), min(c_custkey), max(c_custkey) FROM f JOIN k ON f.fold <> k.fold GROUP BY k.fold"
)
def kfold_split(spark, sf_dir):
    """What split() yields, fold by fold."""
    out = None
    for k, sides in enumerate(KFold("c_custkey", 3).split(read_table(spark, sf_dir, "customer").select("c_custkey"))):
        for name, side in zip(("train", "test"), sides):
            part = side.agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi")).select(F.lit(k).alias("fold"), F.lit(name).alias("side"), "n", "lo", "hi")
            out = part if out is None else out.unionByName(part)
    return out


@query("SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 4 AS fold FROM labels")
def stratified_kfold(spark, sf_dir):
    return StratifiedKFold("doc_id", "quality", 4).assign(read_table(spark, sf_dir, "labels").select("doc_id", "quality"))


@query("SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY md5('9:' || doc_id), doc_id) - 1) % 4 AS fold FROM labels")
def stratified_kfold_shuffled(spark, sf_dir):
    return StratifiedKFold("doc_id", "quality", 4, shuffle=True, random_state=9).assign(read_table(spark, sf_dir, "labels").select("doc_id", "quality"))


@query(
    "WITH f AS (SELECT p_partkey::DOUBLE AS x, p_retailprice AS y, ntile(5) OVER (ORDER BY p_partkey) - 1 AS fold FROM part), k AS (SELECT unnest(range(5)) AS fold),"
    " m AS (SELECT k.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM k JOIN f ON f.fold <> k.fold GROUP BY k.fold)"
    f" SELECT m.fold::BIGINT AS fold, {_r('1-sum((y-a-b*x)*(y-a-b*x))/(count(*)*var_pop(y))', 5)} AS r2 FROM m JOIN f USING (fold) GROUP BY m.fold"
)
def cv_ols_r2(spark, sf_dir):
    df = KFold("p_partkey", 5).assign(read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"))
    return cross_validated_r2(df, "p_partkey", "p_retailprice").select("fold", rounded("r2", 5).alias("r2"))


# Vector expressions and matrices in long form.


def _vectors(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


_X = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)"


@query(f"SELECT event_id, {_r('CASE WHEN z >= 0 THEN -ln(1+exp(-z)) ELSE z-ln(1+exp(z)) END')} AS v FROM (SELECT event_id, value/50-1 AS z FROM events)")
def log_logistic_values(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", rounded(log_logistic(F.col("value") / 50 - 1)).alias("v"))


@query(f"{_X}, p AS (SELECT vec_id, list_transform(x, lambda v: exp(v - list_max(x))) AS q FROM e), u AS (SELECT vec_id, unnest(q) AS v, generate_subscripts(q, 1) - 1 AS pos, list_sum(q) AS s FROM p) SELECT vec_id, pos::INTEGER AS pos, {_r('v/s')} AS v FROM u")
def softmax_rows(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.posexplode(softmax("embedding")).alias("pos", "v")).select("vec_id", "pos", rounded("v").alias("v"))


@query(f"{_X} SELECT vec_id, {_r('sqrt(list_dot_product(x, x))')} AS norm, {_r('list_dot_product(x, x)')} AS squared FROM e")
def row_norm_values(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", rounded(row_norms("embedding")).alias("norm"), rounded(row_norms("embedding", squared=True)).alias("squared"))


@query(f"{_X} SELECT vec_id, {_r('list_sum(list_transform(x, lambda v, i: v*i))')} AS dot FROM e")
def mat_vec_dot(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", rounded(dot("embedding", range(1, 65))).alias("dot"))


@query(f"{_X} SELECT vec_id, {_r('list_distance(x, list_reverse(x))')} AS distance FROM e")
def euclidean(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", rounded(euclidean_distance("embedding", F.reverse("embedding"))).alias("distance"))


_LONG = "WITH x AS (SELECT vec_id AS i, (generate_subscripts(embedding, 1) - 1)::INTEGER AS j, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def _long(spark, sf_dir):
    return matrices.long_form(_vectors(spark, sf_dir), "vec_id", "embedding")


@query(f"{_LONG} SELECT j AS i, i AS j, {_r('v')} AS v FROM x")
def transpose_long(spark, sf_dir):
    return matrices.transpose(_long(spark, sf_dir)).select("i", "j", rounded("v").alias("v"))


@query(f"{_LONG}, w AS (SELECT j AS k, (j % 3) AS c, v FROM x WHERE i < 3 AND j % 3 = i) SELECT x.i, w.c AS j, {_r('sum(x.v*w.v)')} AS v FROM x JOIN w ON x.j = w.k GROUP BY x.i, w.c")
def matmul_long(spark, sf_dir):
    x = _long(spark, sf_dir)
    w = x.where("i < 3 AND j % 3 = i").select(F.col("j").alias("i"), (F.col("j") % 3).alias("j"), "v")
    return matrices.matmul(x, w).select("i", "j", rounded("v").alias("v"))


@query(f"{_LONG} SELECT a.j AS i, b.j AS j, {_r('sum(a.v*b.v)+CASE WHEN a.j=b.j THEN 5e-1 ELSE 0e0 END')} AS v FROM x a JOIN x b ON a.i = b.i GROUP BY a.j, b.j")
def gram_long(spark, sf_dir):
    return matrices.add_diagonal(matrices.gram(_long(spark, sf_dir)), 0.5).select("i", "j", rounded("v").alias("v"))


@query(f"{_LONG} SELECT j, {_r('sum(v*label)')} AS v FROM x JOIN embeddings ON i = vec_id GROUP BY j")
def xty_long(spark, sf_dir):
    y = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("double").alias("y"))
    return matrices.times_vector(_long(spark, sf_dir), y).select("j", rounded("v").alias("v"))


@query(f"{_LONG}, m AS (SELECT j, avg(v) AS m FROM x GROUP BY j), z AS (SELECT i, x.j, v-m AS v FROM x JOIN m USING (j)) SELECT a.j::BIGINT AS i, b.j::BIGINT AS j, {_r('sum(a.v*b.v)')} AS v FROM z a JOIN z b ON a.i = b.i GROUP BY a.j, b.j")
def gram_wide(spark, sf_dir):
    """The centred Gram matrix by partial products in Arrow batches, as wide regressions use it."""
    m = moments(read_table(spark, sf_dir, "embeddings").select("embedding", "label"), "embedding", "label")
    rows = [(int(i), int(j), float(m.gram[i, j])) for i, j in np.ndindex(m.gram.shape)]
    return spark.createDataFrame(rows, "i bigint, j bigint, v double").select("i", "j", rounded("v").alias("v"))


@query("WITH g AS (SELECT var_pop(p_partkey) AS a, covar_pop(p_partkey, p_size) AS b, var_pop(p_size) AS c FROM part)" + "".join(f"{' UNION ALL' if k else ''} SELECT {i}::BIGINT AS i, {j}::BIGINT AS j, {_r(e, 4)} AS v FROM g" for k, (i, j, e) in enumerate([(0, 0, "sqrt(a)"), (1, 0, "b/sqrt(a)"), (1, 1, "sqrt(c-b*b/a)")])))
def cholesky_factor(spark, sf_dir):
    m = moments(_part(spark, sf_dir), *PART)
    factor = cholesky(m.gram / m.n)
    return spark.createDataFrame([(i, j, float(factor[i, j])) for i in range(2) for j in range(i + 1)], "i bigint, j bigint, v double").select("i", "j", rounded("v", 4).alias("v"))


_VARIANCES = "WITH g AS (SELECT var_pop(p_partkey) AS a, covar_pop(p_partkey, p_size) AS b, var_pop(p_size) AS c, covar_pop(p_partkey, p_retailprice) AS u, covar_pop(p_size, p_retailprice) AS v FROM part), z AS (SELECT *, sqrt(a) AS l11, b/sqrt(a) AS l21, sqrt(c-b*b/a) AS l22, u/sqrt(a) AS z1 FROM g)"


@query(f"{_VARIANCES} SELECT 0 AS i, {_r('z1', 4)} AS v FROM z UNION ALL SELECT 1, {_r('(v-l21*z1)/l22', 4)} FROM z")
def forward_solve(spark, sf_dir):
    m = moments(_part(spark, sf_dir), *PART)
    found = forward_substitution(cholesky(m.gram / m.n), m.cross / m.n)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(found)], "i int, v double").select("i", rounded("v", 4).alias("v"))


@query(f"{_VARIANCES} SELECT 0 AS i, {_r('(u-l21*(v/l22))/l11', 4)} AS v FROM z UNION ALL SELECT 1, {_r('v/l22', 4)} FROM z")
def back_solve(spark, sf_dir):
    m = moments(_part(spark, sf_dir), *PART)
    found = back_substitution(cholesky(m.gram / m.n).T, m.cross / m.n)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(found)], "i int, v double").select("i", rounded("v", 4).alias("v"))


# Targets, weights, validation.


@query("SELECT 'quality' AS name, 'binary' AS type_of_target UNION ALL SELECT 'label', CASE WHEN count(DISTINCT label) > 2 THEN 'multiclass' ELSE 'binary' END FROM embeddings UNION ALL SELECT 'price', CASE WHEN bool_and(p_retailprice = floor(p_retailprice)) THEN 'multiclass' ELSE 'continuous' END FROM part")
def target_types(spark, sf_dir):
    parts = [("quality", "labels", "quality"), ("label", "embeddings", "label"), ("price", "part", "p_retailprice")]
    rows = [type_of_target(read_table(spark, sf_dir, t), c).select(F.lit(n).alias("name"), "type_of_target") for n, t, c in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT quality AS label FROM labels UNION SELECT label FROM embeddings")
def all_labels(spark, sf_dir):
    return unique_labels((read_table(spark, sf_dir, "labels"), "quality"), (read_table(spark, sf_dir, "embeddings"), "label"))


@query("SELECT count(DISTINCT quality) = 2 AS is_binary FROM labels")
def is_binary(spark, sf_dir):
    return is_binary_classification(read_table(spark, sf_dir, "labels"), "quality")


@query("SELECT count(DISTINCT c_nationkey) AS class_count FROM customer")
def count_classes(spark, sf_dir):
    return class_count(read_table(spark, sf_dir, "customer"), "c_nationkey")


@query(f"WITH c AS (SELECT label AS class, count(*) AS n FROM embeddings WHERE label < 5 GROUP BY label) SELECT class, {_r('(SELECT count(*) FROM embeddings)/(5*n)')} AS weight FROM c")
def class_weight_balanced(spark, sf_dir):
    return compute_class_weight("balanced", range(5), read_table(spark, sf_dir, "embeddings"), "label").select("class", rounded("weight").alias("weight"))


@query("SELECT 0 AS class, 5e-1 AS weight UNION ALL SELECT 1, 2e0")
def class_weight_dict(spark, sf_dir):
    return compute_class_weight({0: 0.5, 1: 2.0, 9: 1.0}, [0, 1], read_table(spark, sf_dir, "labels"), "quality")


@query(f"SELECT doc_id, {_r('count(*) OVER ()/(2e0*count(*) OVER (PARTITION BY quality))')} AS weight FROM labels")
def sample_weight_balanced(spark, sf_dir):
    return compute_sample_weight("balanced", read_table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality").select("doc_id", rounded("weight").alias("weight"))


@query("SELECT doc_id, CASE quality WHEN 0 THEN 25e-2 ELSE 4e0 END AS weight FROM labels")
def sample_weight_dict(spark, sf_dir):
    return compute_sample_weight({0: 0.25, 1: 4.0}, read_table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality").select("doc_id", "weight")


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE embedding IS NULL OR label IS NULL) AS n_null, min(len(embedding)) AS min_width, max(len(embedding)) AS max_width FROM embeddings")
def validate_counts(spark, sf_dir):
    return check_counts(read_table(spark, sf_dir, "embeddings"), "embedding", "label")


@query("SELECT l_orderkey, trunc(l_extendedprice)::INTEGER AS price, trunc(l_quantity)::INTEGER AS quantity, 1e0 AS weight FROM lineitem")
def integers(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity")
    x = as_integers(array_of(["l_extendedprice", "l_quantity"]))
    return df.select("l_orderkey", F.get(x, F.lit(0)).alias("price"), F.get(x, F.lit(1)).alias("quantity"), sample_weight(df, None).alias("weight"))


def _outcome(act: Callable[[], object]) -> str:
    try:
        act()
    except ValueError as e:
        return type(e).__name__
    return "fine"


def _rows(spark, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query("SELECT 'embeddings' AS name, max(len(embedding)) AS n FROM embeddings UNION ALL SELECT 'part', 2")
def feature_counts(spark, sf_dir):
    return _rows(spark, [("embeddings", num_features(_vectors(spark, sf_dir), "embedding")), ("part", num_features(_part(spark, sf_dir), PART[0]))], "name string, n bigint")


@query("SELECT 'equal' AS name, 'fine' AS outcome UNION ALL SELECT 'columns against array', CASE WHEN max(len(embedding)) = 2 THEN 'fine' ELSE 'ValueError' END FROM embeddings")
def features_consistent(spark, sf_dir):
    part, vectors = _part(spark, sf_dir), _vectors(spark, sf_dir)
    return _rows(spark, [("equal", _outcome(lambda: check_features_consistency(part, part, PART[0]))), ("columns against array", _outcome(lambda: check_features_consistency(part, vectors, PART[0], "embedding")))], "name string, outcome string")


@query(f"{_LONG} SELECT i AS vec_id, j AS pos, {_r('v*2')} AS v FROM x")
def doubles(spark, sf_dir):
    x = _vectors(spark, sf_dir).select("vec_id", F.posexplode(as_doubles("embedding")).alias("pos", "v"))
    return x.select("vec_id", "pos", rounded(F.col("v") * 2).alias("v"))


@query("SELECT false AS is_multilabel FROM labels LIMIT 1")
def multilabel(spark, sf_dir):
    return _rows(spark, [(is_multilabel(read_table(spark, sf_dir, "labels"), "quality"),)], "is_multilabel boolean")


@query("SELECT 'quality' AS name, 'fine' AS outcome UNION ALL SELECT 'price', CASE WHEN bool_and(p_retailprice = floor(p_retailprice)) THEN 'fine' ELSE 'ValueError' END FROM part")
def classification_targets(spark, sf_dir):
    given = [("quality", "labels", "quality"), ("price", "part", "p_retailprice")]
    return _rows(spark, [(n, _outcome(lambda t=t, c=c: check_classification_targets(read_table(spark, sf_dir, t), c))) for n, t, c in given], "name string, outcome string")


# The estimator protocol.


def _parameters(spark, estimator: Estimator) -> DataFrame:
    return _rows(spark, [(k, str(v)) for k, v in estimator.get_params().items()], "name string, value string")


_DEFAULTS = "SELECT unnest(['features','target','alpha','fit_intercept','copy_X','max_iter','tol','solver']) AS name, unnest(['x','y','{}','True','True','1000','0.0001','{}']) AS value"


@query(_DEFAULTS.format("1.0", "auto"))
def parameters(spark, sf_dir):
    return _parameters(spark, Ridge("x", "y"))


@query(_DEFAULTS.format("5.0", "cholesky") + " UNION ALL SELECT 'no such parameter', 'ValueError'")
def parameters_set(spark, sf_dir):
    model = Ridge("x", "y")
    wrong = _rows(spark, [("no such parameter", _outcome(lambda: model.set_params(nothing=1)))], "name string, value string")
    return _parameters(spark, model.set_params(alpha=5.0, solver="cholesky")).unionByName(wrong)


@query(_DEFAULTS.format("3.0", "auto") + " UNION ALL SELECT 'fitted', 'NotFittedError'")
def cloned(spark, sf_dir):
    """A clone of a fitted model has its parameters, but not its fit."""
    model = Ridge(*PART, alpha=3.0).fit(_part(spark, sf_dir)).set_params(features="x", target="y")
    twin = clone(model)
    return _parameters(spark, twin).unionByName(_rows(spark, [("fitted", _outcome(lambda: check_is_fitted(twin, "coef_")))], "name string, value string"))


@query("SELECT 'before' AS name, 'NotFittedError' AS outcome UNION ALL SELECT 'after', 'fine' UNION ALL SELECT 'another attribute', 'NotFittedError'")
def fitted_checks(spark, sf_dir):
    scaler, df = StandardScaler(COLUMNS), _events(spark, sf_dir)
    before = _outcome(lambda: check_is_fitted(scaler))
    scaler.fit(df)
    return _rows(spark, [("before", before), ("after", _outcome(lambda: check_is_fitted(scaler))), ("another attribute", _outcome(lambda: check_is_fitted(scaler, ["coef_"])))], "name string, outcome string")


class _Stamp(ClassifierMixin, Estimator):
    """A classifier that says of every row what another column says."""

    def __init__(self, target: str, column: str):
        self.target, self.column = target, column

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.col(self.column))


@query(f"WITH {_TWO} SELECT {_r('avg((y=p)::INTEGER)')} AS accuracy FROM t")
def classifier_score(spark, sf_dir):
    score = _Stamp("y", "p").score(_two(spark, sf_dir))
    return _rows(spark, [(score,)], "accuracy double").select(rounded("accuracy").alias("accuracy"))


class _Thirds(ClusterMixin, Estimator):
    def __init__(self, key: str):
        self.key = key

    def fit(self, df: DataFrame) -> _Thirds:
        self.labels_ = F.col(self.key) % 3
        return self


@query("SELECT vec_id, vec_id % 3 AS cluster FROM embeddings")
def cluster_fit_predict(spark, sf_dir):
    return _Thirds("vec_id").fit_predict(_vectors(spark, sf_dir).select("vec_id"))


@query("SELECT unnest(['NotFittedError','ConvergenceWarning','DataDimensionalityWarning','UndefinedMetricWarning','EfficiencyWarning','ValueError']) AS name, unnest(['error','warning','warning','warning','warning','error']) AS kind, unnest(['said','said','said','said','said','said']) AS message")
def exceptions(spark, sf_dir):
    """Raised, caught and told by name: the five classes, and the error for bad arguments."""
    rows = []
    for kind in (errors.NotFittedError, errors.ConvergenceWarning, errors.DataDimensionalityWarning, errors.UndefinedMetricWarning, errors.EfficiencyWarning, ValueError):
        try:
            raise kind("said")
        except Exception as e:
            rows.append((type(e).__name__, "warning" if isinstance(e, Warning) else "error", str(e)))
    return _rows(spark, rows, "name string, kind string, message string")


_EXPORTS = (
    "StandardScaler MinMaxScaler LabelEncoder Normalizer LinearRegression Ridge KFold StratifiedKFold train_test_split mean_squared_error mean_absolute_error r2_score mean_absolute_percentage_error"
    " explained_variance_score accuracy_score confusion_matrix precision_score recall_score f1_score log_loss check_array check_xy type_of_target unique_labels compute_class_weight compute_sample_weight clone check_is_fitted"
)


@query(f"SELECT unnest(string_split('{_EXPORTS}', ' ')) AS name, true AS exported")
def exports(spark, sf_dir):
    """What a user imports from the package's root."""
    import tessara

    return _rows(spark, [(n, hasattr(tessara, n)) for n in _EXPORTS.split()], "name string, exported boolean")
