import duckdb
from pyspark.sql import functions as F

from psephos.llm import lines


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id bigint, text string, pos int, hash int, n_lines int").withColumns({c: F.lit(1) for c in ("_doc", "_hash", "r", "d", "h", "drop", "template", "n", "leaf")})


def test_recurring_templates_go_and_copies_stay(spark):
    names = ["ann", "bob", "cat", "dan", "eve", "fay", "gus", "hal", "ida", "joe", "kim", "lea", "max", "nan", "oda"]
    docs = [(i, f"{n} has told a story\nPosted by user {i} at home\nhere {n} has an end") for i, n in enumerate(names)]
    docs += [(100 + i, "one two three four\nfive six seven eight\nnine ten eleven twelve") for i in range(15)]
    rows = {r.doc_id: r for r in lines.deduplicated(frame(spark, docs), 10).collect()}
    assert rows[3].text == "dan has told a story\nhere dan has an end" and rows[3].n_dropped == 1
    assert rows[105].text == docs[20][1] and rows[105].n_dropped == 0


def test_blocks_of_recurring_lines_go_whole(spark):
    """A footer of three lines and short lines go from all texts; lines that many near copies share recur, whole copies don't."""
    footer = "\nShare this page\nAll about us\nTop"
    docs = [(i, f"own{chr(97 + i % 26)}{chr(97 + i // 26)} line" + footer) for i in range(40)]
    near = ["this long text", "has been copied", "very many times", "with small edits", "in one of lines", "and it stays", "as it was", "to the end"]
    docs += [(100 + i, "\n".join([*near[: i % 8], f"edit{chr(97 + i)}x {near[i % 8]}", *near[i % 8 + 1 :]]) + "\nTop") for i in range(26)]
    docs += [(200 + i, "a whole copy\nof two lines") for i in range(20)]
    rows = {r.doc_id: r.text for r in lines.deduplicated(frame(spark, docs)).collect()}
    for i, text in docs:
        if 100 <= i < 200:
            assert rows[i] == f"edit{chr(97 + i - 100)}x {near[(i - 100) % 8]}"
        else:
            assert rows[i] == text.replace(footer, "").replace("\nTop", "")


def test_no_share_of_recurring_lines_keeps_them(spark):
    """Blocks of six and twenty recurring lines beside one own line, and one-line logs with variable fields."""
    own = lambda i: f"own{chr(97 + i % 26)}{chr(97 + i // 26)} line"
    for n in (1, 5, 6, 20):
        block = "\n".join(f"the common line {chr(97 + k) * 3}" for k in range(n))
        rows = lines.deduplicated(frame(spark, [(i, f"{own(i)}\n{block}") for i in range(60)])).collect()
        assert all(r.text == own(r.doc_id) and r.n_dropped == n for r in rows)
    logs = lines.deduplicated(frame(spark, [(i, f"user {i} logged in from host h{i} at {i}:00") for i in range(60)])).collect()
    assert all(r.text == "" and r.n_dropped == 1 for r in logs)


def test_cases(spark):
    docs = [(1, None), (2, ""), (3, "\n\n"), (4, "a b c"), (4, "a b c"), (None, "a b c"), (5, "a b c\n" * 3000), (6, "z " * 50000)]
    rows = lines.deduplicated(frame(spark, docs)).collect()
    assert sorted((str(r.doc_id), r.text) for r in rows if r.text) == sorted((str(i), t) for i, t in docs if t)
    assert [r.text for r in rows if r.doc_id == 1] == [None]
    assert all(r.pos == 1 for r in rows)
    assert lines.deduplicated(frame(spark, [])).collect() == []


def test_same_as_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    ours = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.deduplicated(spark.read.parquet(path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    assert {r[0]: r[1:] for r in db.execute(lines.ORACLE_SQL).fetchall()} == ours
    assert sum(n for _, _, n in ours.values()) > 0
