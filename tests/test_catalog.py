import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from quarrylens import catalog
from quarrylens.operators import secrets


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    for f in glob.glob(f"{tiny}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return [plain(x) for x in v]
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert all(re.fullmatch(r"[a-z0-9_]+", name) for name in catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, tiny, duck, name):
    df = catalog.QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    result = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(row[names.index(c)]) for c in columns]) for row in result.fetchall())
    assert got == want


def test_assigned_secrets_with_running_numbers(spark, tmp_path):
    """Ids past 123,456, as tables of over sf0.1 have them; ids with a digit four times in a row are none."""
    events, ids = f"{tmp_path}/events.parquet", (123456, 123457, 1234560, 1234561, 3123456, 1111123, 9123456, 5999998)
    c = duckdb.connect()
    rows = f"SELECT unnest([{', '.join(map(str, ids))}])::BIGINT AS event_id, 1::BIGINT AS user_id, 'click' AS event_type"
    c.execute(f"copy ({rows}) to '{events}'")
    c.execute(f"create view events as select * from '{events}'")
    got = sorted(tuple(r) for r in catalog.QUERIES["r1_assigned_secrets"](spark, str(tmp_path)).select("seq", "rule", "value").collect())
    assert got == sorted(c.execute(catalog.ORACLES["r1_assigned_secrets"]).fetchall())
    assert {seq for seq, _, _ in got} >= {123456, 1234560, 1234561, 3123456}
    plain_rule = spark.createDataFrame([('password = "Zk9123456pqWm"',), ('password = "Zk9***pqWm"',), ('password = "Zk912345pqWm"',)], "text string")
    assert [r.value for r in secrets.scan(plain_rule).collect()] == ["Zk912345pqWm"]


@pytest.mark.parametrize("name", ["x13_search_fuzzy", "x12_search_regex"])
def test_searches_work_out_lines_once(spark, tiny, name):
    """Filters that move below the lines and records must not repeat trimming or normalising for each of their terms."""
    plan = catalog.QUERIES[name](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]
    assert filters and max(line.count("trim(") for line in filters) == 0
    assert max(line.count("translate(") for line in filters) <= 1
