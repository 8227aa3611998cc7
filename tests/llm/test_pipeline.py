"""The pipeline's stages against definitions, each on its own input; queries that have SQL."""

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from quillon import llm
from quillon.llm import common, op05_lines

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, D, "documents")
    first = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = common.written(stage(spark, docs, D))
        after = docs.collect()
        if k < 4:
            assert docs.columns == first, name
            assert {r.doc_id for r in after} <= {r.doc_id for r in before} and len(after) == len({r.doc_id for r in after})
        if name == "line_dedup":
            want = op05_lines.brute_force([(r.doc_id, r.text) for r in before])
            import hashlib

            assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in after} == {d: v[1] for d, v in want.items()}
            assert all(r.n_chars == len(r.text) for r in after)
    assert {r.doc_id for r in before} == {r.doc_id for r in after}


def test_run_is_the_stages(spark):
    a = corpus_pipeline.run(spark, D)
    assert a.count() > 0 and "sequence_id" in a.columns


def plain(df):
    """Rows in order. Columns of whole numbers with nulls come as floats from Spark and as integers from SQL."""
    return sorted((tuple(None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    want = con.execute(llm.oracle_sql()[name]).df()
    got = llm.queries()[name](spark, D).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert plain(got[cols]) == plain(want[cols])
