"""Every core query with SQL gives the rows of its SQL on the smallest test data."""

import os
import sys

import pytest

from skein.plans import registry

DATA = os.environ.get("SKEIN_TEST_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def canonical(df):
    df = df.reindex(sorted(df.columns), axis=1)

    def plain(x):
        if x is None or x != x:
            return None
        return round(float(x), 5) if isinstance(x, float) or hasattr(x, "dtype") else x

    return sorted(repr(tuple(plain(x) for x in row)) for row in df.itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) & set(registry.queries())))
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    ours, theirs = registry.queries()[name](spark, DATA).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


@needs_data
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "rank", "id", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_does_not_import_the_optional_part():
    import subprocess

    code = "import sys, skein.plans.registry, skein.operators.assist, skein.streaming.ingest, skein.sources.parse; sys.exit(any(m.startswith('skein.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(__file__))).returncode == 0


@needs_data
def test_every_query_has_its_rounds(spark):
    rows = registry.queries()["multi_round"](spark, DATA).collect()
    near = registry.queries()["knn_batch"](spark, DATA).where("rank <= 5").collect()
    by = {}
    for r in rows:
        by.setdefault(r.query_id, {})[r.id] = r
    assert set(by) == {r.query_id for r in near} and all(5 <= len(x) <= 10 for x in by.values()) and len(rows) == sum(map(len, by.values()))
    own = {(r.query_id, r.id) for r in near}
    assert all((r.round == 1) == ((r.query_id, r.id) in own) for r in rows)
