"""The registered queries against their SQL, and the pipeline's stages."""

import duckdb
import pytest

import corpus_pipeline
from vendorlytics.llm import catalog, oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = catalog.queries()[name](spark, SF)
    res = con.execute(oracle.ORACLE[name])
    columns = [d[0] for d in res.description]
    want = sorted(tuple(map(str, r)) for r in res.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == want and sorted(df.columns) == sorted(columns)


def test_stages_return_documents_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    total = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert set(out.columns) == set(corpus_pipeline.COLUMNS), name
        assert 0 < out.count() <= total
    last = corpus_pipeline.run(spark, SF)
    assert last.count() > 0 and last.where("NOT round_trip").count() == 0
