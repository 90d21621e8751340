import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from psephos.llm import langid, lines, mixing
from psephos.llm.storage import split_by

from .test_decontaminate import brute as brute_leaks
from .test_near import brute as brute_near

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(90001, None, None, None, 0), (90002, "12 34", "en", "src0", 5), (90003, "the of and " * 3, "en", None, 33)]
    docs = docs.unionByName(spark.createDataFrame(odd, SCHEMA))
    rows = {r.doc_id: r for r in docs.collect()}

    kept = {r.doc_id: r for r in corpus_pipeline.language_id(spark, docs, sf).collect()}
    und = {r.doc_id for r in langid.identify(docs).where("lang_pred = 'und' or ambiguous").collect()}
    assert {90001, 90002} <= und and set(kept) == set(rows) - und
    assert all(kept[i] == rows[i] for i in kept)

    near = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()}
    assert near == {i for i, _, c in brute_near([(i, r.text) for i, r in rows.items()]) if c == i}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, sf).collect()}
    assert clean == {i for i, _, n, _ in brute_leaks([(i, r.text) for i, r in rows.items()], items) if not n}

    mix = corpus_pipeline.mixing_sources(spark, docs, sf).collect()
    assert sorted(r.doc_id for r in mix) == sorted(rows)


def test_line_stage_against_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = corpus_pipeline.line_dedup(spark, docs, "")
    assert out.columns == docs.columns
    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    wanted = {r[0]: r[1:] for r in db.execute(f"SELECT d.doc_id, o.text, d.lang, d.source, CASE WHEN n_dropped > 0 THEN length(o.text) ELSE n_chars END FROM ({lines.ORACLE_SQL}) o JOIN documents d USING (doc_id)").fetchall()}
    assert {r.doc_id: (r.text, r.lang, r.source, r.n_chars) for r in out.collect()} == wanted


def test_mixing_stage_against_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = corpus_pipeline.mixing_sources(spark, docs, "")
    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    wanted = {r[0]: r[1:] for r in db.execute(f'SELECT doc_id, block, slot, "offset" FROM ({mixing.ORACLE_SQL})').fetchall()}
    assert {r.doc_id: (r.block, r.slot, r.offset) for r in out.collect()} == wanted


def test_run_and_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, "x")], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text, "en", "a", 5), (None, text, "en", "a", 5)], SCHEMA)
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 1]
    assert mixing.mixed(docs).count() == 4


def test_clashing_names(spark):
    """Further columns may be named like anything that a stage uses."""
    names = ["h", "r", "d", "x", "_id", "_hash", "_doc", "hash", "n", "s", "b", "turn", "start", "place", "period", "count", "first", "component_id", "node", "term", "spans", "lang_pred", "template", "pos", "a.b", "`q`", "text.x", "LEAF", "Chunk", "r.doc_id"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    docs = docs.unionByName(docs.limit(3)).select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, sf).collect()
        assert rows and all([r[c] for c in names] == list(range(len(names))) for r in rows)


def test_maps_and_other_types(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "en", "a", 5), (1, text + " x", "en", "a", 5), (2, None, None, None, None)], SCHEMA).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, "/root/testdata/sf0.001").collect()
        assert all(r.m == {"k": 1} for r in rows)
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").orderBy("doc_id").collect()] == [1, 2]


def test_near_stage_joins_only_rows_that_may_go(spark, monkeypatch):
    told = []
    monkeypatch.setattr(corpus_pipeline, "split_by", lambda *a: told.append(split_by(*a)) or told[-1])
    text = lambda i: " ".join(f"d{i}w{j}" for j in range(30))
    rows = [(i, text(i), "en", "a", 5) for i in range(200)] + [(500, text(7) + " x", "en", "a", 5), (501, text(9), "en", "a", 5), (None, text(3), "en", "a", 5)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect()) == [-1, *range(200)]
    assert {500, 501} <= {r.r.doc_id for r in told[0].where("_maybe").collect()} and told[0].where("_maybe").count() <= 6
