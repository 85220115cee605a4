from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = ["region", "nation", "supplier", "lineitem", "orders", "events"]
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the generated tables")

# Operators of the inventory, by section letter and number.
INVENTORY = (
    [f"a{i:02d}" for i in range(1, 13)] + [f"b{i:02d}" for i in range(1, 44)]
    + [f"c{i:02d}" for i in range(1, 6)] + [f"d{i:02d}" for i in range(1, 36)]
    + [f"e{i:02d}" for i in range(1, 9)] + [f"f{i:02d}" for i in range(1, 6)]
    + [f"g{i:02d}" for i in range(1, 7)] + [f"h{i:02d}" for i in range(1, 29)]
    + [f"k{i:02d}" for i in range(1, 16)]
)


def test_every_operator_has_a_query():
    have = {name[:3] for name in entry.queries()}
    assert [op for op in INVENTORY if op not in have] == []
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["b10_minute_boundary_gate", "b20_tolerance_filter",
                                  "d02_group_quantiles", "e01_top_categories", "k13_persona_overview"])
def test_spark_and_sql_agree(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(repr(tuple(r[i] for i in at)) for r in result.fetchall())
    assert got == want and got


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
