"""Every registered query against its DuckDB oracle at sf0.001 (strict values)."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "mean_latency" in df.columns


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    from collections import Counter

    from scripts.check_oracle import canon, duck_type
    df = QUERIES[key](spark, SF)
    cols, got = df.columns, df.collect()
    if key not in ORACLES:
        assert len(got) >= 0
        return
    cur = duck.execute(ORACLES[key])
    ocols = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(cols) == sorted(ocols)
    otypes = {c[0]: str(c[1]) for c in cur.description}
    assert {c: duck_type(t) for c, t in df.dtypes} == otypes
    o1 = sorted(range(len(cols)), key=lambda i: cols[i])
    o2 = sorted(range(len(ocols)), key=lambda i: ocols[i])
    assert Counter(tuple(canon(r[i]) for i in o1) for r in got) == \
        Counter(tuple(canon(r[i]) for i in o2) for r in want)
