"""Every query against the same in SQL, and the entry point with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from gridspark.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def sql(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def rows(df):
    def plain(x):
        if isinstance(x, list | tuple) or hasattr(x, "tolist") and getattr(x, "ndim", 0):
            return str(list(x))
        if x is None or x is pd.NA or pd.isna(x):
            return ""
        return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sql, tiny, name):
    assert rows(QUERIES[name](spark, tiny).toPandas()) == rows(sql.sql(ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() == 12
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_data_operators():
    code = "import sys; sys.modules['gridspark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'audit' in e.queries() and not any(q.startswith('op') for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


@pytest.mark.parametrize("name", ["rule_rounding_drift", "rule_rounding_typed_totals"])
def test_prices_that_add_up_by_chance_are_no_totals(spark, tmp_path, name):
    """The fourth price is the sum of the three before it, up to less than one, and shows another figure."""
    prices = {1: (100.4, 100.4, 100.4, 301.2), 2: (100.4, 100.4, 100.4, 301.2, 7.0)}
    items = pd.DataFrame([(k, n, p, 0.0) for k, of in prices.items() for n, p in enumerate(of, 1)], columns=["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"])
    items.to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.sql(ORACLES[name]).df())
