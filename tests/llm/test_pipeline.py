import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessara.llm.quality import fit

FOLDER = "/root/testdata/sf0.001"


def plain(spark, docs):
    """The rows that the first four stages keep, by plain Python: [(doc_id, text)]."""
    model = fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    docs = [d for d, s in zip(docs, model.score([t for _, t in docs])) if s >= corpus_pipeline.QUALITY]
    left = brute.without_later_runs(docs)
    docs = [(i, left[i, t]) for i, t in docs if left[i, t] == t or left[i, t].strip()]
    docs.sort()
    _, group = brute.similar([t for _, t in docs])
    docs = [d for k, d in enumerate(docs) if group[k] == k]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    return [d for d in docs if not (lambda w, h, _: h > 0 and 20 * h >= w)(*brute.contamination(d[1], items))]


def test_run_matches_the_plain_version(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing"]
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(spark, docs)
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {(r.doc_id, r.size) for r in rows} == {(i, len(brute.TOKEN.findall(t))) for i, t in want} and len(rows) == len(want)
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r.size
    goal = brute.targets(size)
    assert all(r.target == pytest.approx(goal[r.source]) and r.taken <= 2 * r.size for r in rows)


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_and_take_odd_rows(spark, frame, k):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(1, long, "en", "s", 5), (2, long, "en", None, 5), (2, long, "en", None, 5), (None, None, None, None, None), (3, "", None, "s", 0), (4, "short", "en", "s", 5)]
    docs = spark.createDataFrame(rows, schema)
    out = corpus_pipeline.STAGES[k][1](spark, docs, FOLDER)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert {r.doc_id for r in out.collect()} <= {1, 2, 3, 4, None}
    assert corpus_pipeline.STAGES[k][1](spark, docs.where(F.lit(False)), FOLDER).count() == 0
