import duckdb
import pytest

import __spark_entry__ as entry
from inkdiff.plans import registry

SMALL = "/root/testdata/sf0.001"
FAST = ["change_rows", "signals_modal", "citations_valid", "segment_clauses", "class_metrics", "doc_metadata", "candidate_topk", "recent_log", "state_transitions", "register_users"]


def test_every_statement_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in "part documents labels pages customer orders events conversations".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    out = registry.QUERIES[name](spark, SMALL)
    columns = sorted(out.columns)
    theirs = db.execute(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})").fetchall()
    ours = [tuple(r) for r in out.select(columns).collect()]
    assert sorted(map(str, ours)) == sorted(map(str, theirs))
