"""Every catalogued query against its SQL, and what the plans look like."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessara.plans import catalog
from tessara.sources import TABLES, read_table
from tessara.streaming import apply_model

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_matches_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    found = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(repr(tuple(r)) for r in found.fetchall())
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert got == want and got


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_asked(spark):
    text = plan(catalog.ols_predict(spark, FOLDER))
    assert "ReadSchema: struct<p_partkey" in text and "p_name" not in text and "Exchange" not in text
    text = plan(catalog.regression_report(spark, FOLDER))
    assert text.count("FileScan") == 1 and "l_comment" not in text and text.count("Exchange") == 1


def test_confusion_scans_once(spark):
    df = catalog.confusion(spark, FOLDER)
    df.collect()
    assert plan(df).partition("Initial Plan")[0].count("FileScan") == 1


def test_projections_need_no_python(spark):
    for name in ("standard_scale", "softmax_rows", "label_encode", "kfold_shuffled", "confusion"):
        assert "Arrow" not in plan(catalog.QUERIES[name](spark, FOLDER)) and "Python" not in plan(catalog.QUERIES[name](spark, FOLDER))


def test_models_hold_for_streams(spark, tmp_path):
    from tessara import LinearRegression, StandardScaler

    part = read_table(spark, FOLDER, "part").select("p_partkey", "p_size", "p_retailprice")
    model, scaler = LinearRegression(["p_partkey"], "p_retailprice").fit(part), StandardScaler(["p_size"]).fit(part)
    part.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))
    q = apply_model(scaler, apply_model(model, stream)).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("scored").collect())) == sorted(map(tuple, scaler.transform(model.predict(part)).collect()))
    with pytest.raises(ValueError):
        apply_model(model, part)
