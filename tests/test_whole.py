import os

import duckdb
import pytest

import __spark_entry__ as entry
from recollect.plans.retrieval import mem
from recollect.sources import fixtures as fx
from test_entry import SF, plain


@pytest.mark.parametrize("name", ["d4_persistent_memory", "e7_summary", "f4_holm", "g12_group_recalls", "h9_session_summary"])
def test_sessions_of_one_length_like_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got = entry.queries()[f"{name}_cut"](spark, SF)
    want = con.execute(entry.oracle_sql()[f"{name}_cut"])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), columns)


def test_no_row_is_left_out(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn").collect()
    got = entry.queries()["a2_sessions"](spark, SF).collect()
    assert sorted((r.session_id, r.turn) for r in got) == sorted((r.conv_id, r.turn) for r in rows)
    assert max(r.age for r in mem(spark, SF).collect()) >= 3 > max(r.age for r in mem(spark, fx.Cut(SF)).collect())
    cut = entry.queries()["a2_sessions_cut"](spark, SF).collect()
    assert len(cut) < len(got) and {r.turn for r in cut} == {0, 1, 2, 3}
