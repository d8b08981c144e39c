import os

import duckdb
import pytest

from tierstone.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "region"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_whole_merges_read_every_write(spark, tmp_path):
    ts = "timestamp_ntz'2024-01-01 00:00:00'"
    # 5,000 writes, a key per write; every seventh is a delete
    spark.range(5000).selectExpr("id AS event_id", f"{ts} AS ts", "id AS user_id", "if(id % 7 = 0, 'error', 'click') AS event_type", "1.0D AS value", "'' AS props").write.parquet(f"{tmp_path}/events.parquet")
    deletes = len(range(0, 5000, 7))
    assert QUERIES["merge_keep_tombstones"](spark, str(tmp_path)).count() == 5000
    assert QUERIES["merge_drop_tombstones"](spark, str(tmp_path)).count() == 5000 - deletes
    assert QUERIES["as_of_state"](spark, str(tmp_path)).count() == 2500 - len(range(0, 2500, 7))
