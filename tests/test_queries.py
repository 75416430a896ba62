import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
# One query of every family; the rest run in the correctness check.
NAMES = ["normalize_text", "verse_start_end", "line_hint", "range_stats", "active_on_day", "perturb_text", "best_shift", "read_toc", "stream_rate_limit"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cell = lambda x: "null" if x is None or x != x or str(x) == "<NA>" else f"{float(x):.6f}" if isinstance(x, (int, float)) else str(x)
    rows = lambda df: sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)
