"""Each registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quantloom.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df):
    """Rows as sorted tuples of comparable texts; doubles to five places."""

    def one(v):
        if v is None or str(v) in ("NaT", "<NA>") or v != v:
            return "null"
        if isinstance(v, float):
            return f"{round(v, 5) + 0.0:.5f}"
        t = str(v)
        return t[:10] if t.endswith("00:00:00") else t[:19] if t[4:5] == "-" and t[10:11] == " " else t

    cols = sorted(df.columns)
    return cols, sorted(tuple(one(v) for v in row) for row in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(SQL[name]).df()
    cols, rows = plain(got)
    assert cols == sorted(want.columns)
    ints = [c for c in cols if str(got[c].dtype).startswith(("int", "Int")) != str(want[c].dtype).startswith(("int", "Int")) and got[c].notna().all() and want[c].notna().all()]
    assert not ints, "columns of whole numbers in one engine only"
    assert rows == plain(want)[1]


@pytest.mark.parametrize("name", ["target_weight_rebalance", "signal_backtest"])
def test_simulations_keep_cash(spark, name):
    rows = QUERIES[name](spark, DATA).toPandas()
    assert len(rows) and (rows["cash"] >= -1e-6).all() and (rows["equity"] > 0).all()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert {"rank_ic_series", "pit_asof_join"} <= {*__spark_entry__.queries()}
    assert {*__spark_entry__.oracle_sql()} <= {*__spark_entry__.queries()}
