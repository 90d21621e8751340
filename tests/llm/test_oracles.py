import duckdb
import pytest

from psephos.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for table in "documents embeddings benchmark conversations".split():
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    wanted = db.execute(queries.ORACLES[name])
    names = [d[0] for d in wanted.description]
    found = queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(names)
    plain = lambda rows: sorted(([round(v, 6) if isinstance(v, float) else v for v in r] for r in rows), key=str)
    assert plain(map(tuple, found.select(*names).collect())) == plain(wanted.fetchall())


def test_every_number_has_a_query():
    assert {int(name[2:].split("_")[0]) for name in queries.QUERIES} == set(range(1, 14))
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"op2_pii", "op6_language_id", "op13_cross_tokenizer_alignment"}
