import duckdb
import pytest

import __spark_entry__
from psephos.plans import catalog

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_name_queries():
    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries) and len(queries) > 80


ORACLES = {name: sql for name, sql in __spark_entry__.oracle_sql().items() if name in catalog.ORACLES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events pages documents".split():
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = db.execute(ORACLES[name])
    names = [d[0] for d in expected.description]
    found = __spark_entry__.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(names)
    plain = lambda rows: sorted(([round(v, 6) if isinstance(v, float) else v for v in r] for r in rows), key=str)
    assert plain(map(tuple, found.select(*names).collect())) == plain(expected.fetchall())
