import json
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from recollect.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SOME = ["a3_beliefs", "a5_configs", "a8_upgrade", "b1_beliefs", "b4_sessions", "b15_structured_matches", "c1_canonical", "c6_weights", "d4_persistent_memory", "d6b_uncapped_fold", "d11_corrected", "d14_native_ranks", "d15_top_k", "d16_live_memory", "d18_text_persistent",
        "e7_summary", "f1_recall_delta", "f5_compare", "g1_belief_stats", "g4_contradictions", "g9_clean_states", "g10_event_counters", "g12b_group_deltas", "g18_manifest", "h1_archives", "h5_first_turn", "h6_no_op", "h7_no_op_lists", "h8_clean_guard", "i2_pairing", "i3_evaluation", "i4_verify_pairing", "i5_gate", "j1_embed",
        "a3b_malformed_beliefs", "a7b_published_runs", "a11b_malformed_traces", "a13b_encoder_cache", "c8b_file_digests", "d6_capped_memory", "d8_semantic_merge", "d9_override", "d16b_live_from_batch", "f6_final_delta", "g13c_setting_summaries", "g16_text_report", "i3b_evaluation_of_files"]


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", SOME)
def test_like_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), columns)


def test_registered():
    assert set(ORACLE_SQL) == set(QUERIES) and len(QUERIES) > 100 and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_a_broken_import_is_not_hidden(tmp_path):
    code = "import sys; sys.modules['recollect.llm.common'] = None; import __spark_entry__ as e; e.queries()"
    out = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry.__file__), capture_output=True, text=True)
    assert not os.path.isdir(os.path.join(os.path.dirname(entry.__file__), "recollect", "llm")) or "recollect.llm.common" in out.stderr and out.returncode


def test_works_without_the_llm_folder(tmp_path):
    code = "import sys; sys.modules['recollect.llm'] = None; import __spark_entry__ as e; import json; print(json.dumps([len(e.queries()), any(n.startswith('op') for n in e.queries())]))"
    out = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry.__file__), capture_output=True, text=True, check=True).stdout
    assert json.loads(out) == [len(QUERIES), False]
