"""Every registered query against its SQL, and the plans that matter."""

import duckdb
import pytest

from ledgerline.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = "orders events documents".split()


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, base, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    wanted = base.sql(registry.oracle_sql()[name])
    order = [wanted.columns.index(c) for c in columns]
    assert got  # what has no rows proves nothing
    assert plain(got) == plain(tuple(r[k] for k in order) for r in wanted.fetchall())


def test_claims_rank_before_the_shuffle(spark, capsys):
    registry.queries()["claim_next_topk"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "WindowGroupLimit" in plan and "PushedFilters" in plan


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
