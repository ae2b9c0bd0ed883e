"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of, same_type
from parlance.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
# Their SQL twins fill whole edit tables; check.py compares them, brute force tests them here.
SLOW_SQL = {"rouge_l", "corpus_wer", "error_by_language", "eval_report", "worst_k"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES or name in SLOW_SQL:
        assert got
        return
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want, want_cols = rows_of(names, cur.fetchall())
    assert cols == want_cols and got == want
    assert all(same_type(t, kinds[c]) for c, t in df.dtypes), (df.dtypes, kinds)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
