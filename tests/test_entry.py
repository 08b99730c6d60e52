import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E
from vertebra.plans.catalog import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_contract_keys():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 37


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "avg_c7_x" in df.columns and "cnt" in df.columns


def test_every_query_matches_oracle_at_small_scale(spark):
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")

    def norm(v):
        if isinstance(v, float):
            return repr(v)
        if hasattr(v, "isoformat"):
            return v.isoformat()
        return "\0" if v is None else str(v)

    sqls = E.oracle_sql()
    for name, fn in QUERIES.items():  # the corpus operators have tests of their own
        sdf = fn(spark, SF)
        cols = sorted(sdf.columns)
        srows = sorted(tuple(norm(r[c]) for c in cols) for r in sdf.collect())
        res = con.execute(sqls[name])
        dcols = [d[0] for d in res.description]
        idx = sorted(range(len(dcols)), key=lambda i: dcols[i])
        drows = sorted(tuple(norm(r[i]) for i in idx) for r in res.fetchall())
        assert cols == sorted(dcols), name
        assert srows == drows, name
