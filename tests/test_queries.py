"""Every registered array query against the same in SQL."""

import pytest
from conftest import rows_of

from gridloom.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLE:
        assert len(got)
        return
    want = duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pearson_of_constants(spark, tmp_path):
    """User 1 has two days of one value, which the filter drops, 2 seven of them, 3 none, 4 gaps, 5 no pair of values."""
    import duckdb

    days = {1: [(5, 1), (5, 2)], 2: [(5, i) for i in range(7)], 3: [(i * i, i) for i in range(7)], 4: [(i * i, None if i == 3 else i) for i in range(8)], 5: [(i, None) for i in range(6)]}
    rows = [(i, f"2024-01-{i + 1:02d} 00:00:00", user, kind, None if v is None else float(v)) for user, vs in days.items() for i, pair in enumerate(vs) for kind, v in zip(("view", "click"), pair, strict=True)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value", "'{}' props").write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = {r.d1: (str(r.r), r.n) for r in QUERIES["pearson"](spark, str(tmp_path)).collect()}
    assert got == {d1: (str(r), n) for d1, r, n in c.sql(f"SELECT d1, r, n FROM ({ORACLE['pearson']})").fetchall()}
    assert set(got) == {2, 3, 4, 5} and got[2] == ("nan", 7) and got[5] == ("None", 6)
