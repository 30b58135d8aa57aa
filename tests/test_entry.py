import duckdb
import pytest

import __spark_entry__ as driver
from relievo.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that end in iterations are tested on their own.
CHECKED = sorted(set(catalogue.oracle_sql()) - {"components_clean", "knn_spatial", "icp_pairs_one_to_one"})


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def rows(table):
    return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in table), key=repr)


def test_entry(spark):
    assert driver.entry(spark).columns == ["region", "n", "rmse"]


def test_oracles_belong_to_queries():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_against_sql(spark, con, name):
    got = catalogue.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(f'SELECT {", ".join(chr(34) + c + chr(34) for c in columns)} FROM ({catalogue.oracle_sql()[name]})').fetchall()
    mine = [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in got.select(*columns).collect()]
    a, b = rows(mine), rows([tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in want])
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=2e-4, nan_ok=True) if not any(isinstance(v, (str, type(None), bool)) for v in (*x, *y)) else all(p == q or isinstance(p, float) and abs(p - q) < 2e-4 for p, q in zip(x, y, strict=True))
