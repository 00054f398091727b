"""Every core query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

from plumbline.oracle import SQL
from plumbline.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
#: Views of the same plan as verdict_by_stream, left to the driver's own comparison.
SLOW = {"replay_all_prefixes", "replay_by_settings", "replay_divergence", "verdict_counts"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def plain(rows):
    def one(v):
        if v is None or v != v:
            return "null"
        return f"{v + 0.0:.6f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    sql = con.execute(SQL[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in sql.fetchall()]
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert plain(got) == plain(want)


def test_queries_without_sql_run(spark):
    for name in sorted(set(QUERIES) - set(SQL)):
        if not name.startswith("simulation"):
            assert QUERIES[name](spark, SF).count() >= 0


def test_simulated_causes_are_named(spark):
    from plumbline.queries import simulated
    from plumbline.operators import tallies

    rows, _ = simulated(spark)
    assert tallies.misattribution(rows, ["cell"]).where("accuracy < 1").count() == 0
    assert {r["truth"]: r["detection_rate"] for r in tallies.tally(rows, ["truth"], 12).collect() if r["truth"] != "stable"} == {"judge": 1.0, "system": 1.0, "both": 1.0}
