"""Every base query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from verdex import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    assert plain(tuple(r) for r in df.select(columns).collect()) == plain(rel.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_name_resolution_takes_the_first_tier(spark):
    found = {r["query"]: (r["entry"], r["tier"]) for r in queries.QUERIES["name_resolution"](spark, SF).collect()}
    assert found["small ring"] == ("small ring", 0)
    assert found["SMALL-RING"] == ("small ring", 1)
    assert found["smallring"] == ("small ring", 2)
    assert found["ring small"] == ("small ring", 3)
    assert found["msall ring"] == ("small ring", 4)


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 150
    assert set(queries.ORACLE_SQL) <= set(entry.queries())


def test_large_alias_buckets_are_refused(spark):
    from verdex.operators import identity

    def spellings(n):
        letters = "abcdefgh"
        return spark.createDataFrame([("".join(c.upper() if i >> k & 1 else c for k, c in enumerate(letters)),) for i in range(n)], "name string")

    assert identity.separator_aliases(spellings(64), "name").count() == 64 * 63 // 2
    with pytest.raises(Exception, match="exceeds safety limit.*members=65"):
        identity.separator_aliases(spellings(65), "name").collect()
