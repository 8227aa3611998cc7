"""The archive query against SQL, row by row, nulls as nulls."""

import duckdb
import pytest

from quillon import llm
from quillon.llm.op10_warc import SQL


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_rows(spark, sf):
    d = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{d}/pages.parquet'")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = con.execute(f"select {', '.join(names)} from ({SQL})").fetchall()
    got = [tuple(r) for r in llm.queries()["op10_warc"](spark, d).select(*names).collect()]
    assert len(got) > 0 and sorted(got, key=str) == sorted(want, key=str)
