import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from psephos.functions import calendar, text
from psephos.operators import checks, joins
from psephos.sources import delimited, documents, snapshots, synthetic
from psephos.streaming import ledger as streams


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Year\tVotes\n2000\t-1\n")
    r = delimited.bronze(spark, str(tmp_path / "a.csv"), "s", "2020-01-01").first()
    assert (r.year, r.votes, r.source_id) == ("2000", "-1", "s") and len(r.row_hash) == 64
    (tmp_path / "b.csv").write_text("only\n1\n")
    with pytest.raises(ValueError):
        delimited.delimiter(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text("# note\na,b\n1,2\n")
    assert delimited.commented(spark, str(tmp_path / "c.csv")).first().asDict() == {"a": "1", "b": "2"}
    (tmp_path / "d.csv").write_bytes("é;2\n".encode("latin-1"))
    assert delimited.headerless(spark, str(tmp_path / "d.csv"), ["n", "v"]).first().n == "é"
    for name, data in (("u8", "﻿é\nb".encode()), ("u16", "é\nb".encode("utf-16")), ("cp", "é’\nb".encode("cp1252"))):
        (tmp_path / f"{name}.txt").write_bytes(data)
    lines = {r.path.rsplit("/", 1)[1]: r.line for r in delimited.any_charset(spark, f"{tmp_path}/*.txt").where("line <> 'b'").collect()}
    assert lines == {"u8.txt": "é", "u16.txt": "é", "cp.txt": "é’"}
    assert delimited.files_of(spark, str(tmp_path), "*.csv", "^b").count() == 3


def test_documents(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<R><Contest text="House 1"><Choice text="X" party="DEM" totalVotes="5"/><Choice text="Y" party="REP" totalVotes="6"/></Contest></R>')
    assert [(r.contest, r.choice, r.votes) for r in documents.xml_contests(spark, f"{tmp_path}/a.xml").collect()] == [("House 1", "X", 5), ("House 1", "Y", 6)]
    (tmp_path / "p.json").write_text(json.dumps({"results": [{"id": "a", "years": [2020]}]}))
    assert documents.json_pages(spark, f"{tmp_path}/p.json", "id string, years array<int>").first().years == [2020]
    (tmp_path / "m.json").write_text(json.dumps([["NAME", "v"], ["x", "1"], ["y", None]]))
    assert sorted(map(tuple, documents.matrix_json(spark, f"{tmp_path}/m.json").collect()), key=str) == [("x", "1"), ("y", None)]
    (tmp_path / "k.json").write_text(json.dumps({"c1": {"n": 3}}))
    assert tuple(documents.keyed_json(spark, f"{tmp_path}/k.json", "n int").first()) == ("c1", 3)
    pages = spark.createDataFrame([(1, "<table><tr><th>A<td>b &amp; c</tr></table>"), (2, None), (3, "<p>")], "id int, html string")
    assert [tuple(r) for r in documents.html_cells(pages, "id", "html").collect()] == [(1, 0, 0, 0, "A"), (1, 0, 0, 1, "b & c")]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/a.txt", "x\ty\n1\t2")
        z.writestr("in/b.md", "no")
    assert [(r.member, r.line) for r in documents.zip_lines(spark, f"{tmp_path}/z.zip", ".*txt").orderBy("pos").collect()] == [("in/a.txt", "x\ty"), ("in/a.txt", "1\t2")]
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>Name</t></si><si><t>Votes</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="AA2" t="s"><v>1</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>x</t></is></c><c r="AA3"><v>7</v></c></row></sheetData></worksheet>')
    cells = documents.sheet_cells(spark, f"{tmp_path}/s.xlsx")
    assert [(r["name"], r.votes) for r in documents.with_header(cells, ["path", "sheet"], 2, ["Name", "Votes"]).collect()] == [("x", "7")]
    assert io is not None


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    root = str(tmp_path / "snap")
    snapshots.write_once(df, root, "2026-01-01")
    snapshots.write_once(df.limit(1), root, "2026-01-02")
    with pytest.raises(Exception, match="EXISTS|exists"):
        snapshots.write_once(df, root, "2026-01-01")
    assert snapshots.read_snapshots(spark, root).count() == 3 and snapshots.read_snapshots(spark, root, "2026-01-01").count() == 2
    snapshots.write_bundle({"t": df}, {"t": ["k"]}, str(tmp_path / "b"), "run1", {"tier": 1})
    assert snapshots.bundle_table(spark, str(tmp_path / "b"), "run1", "t").columns == ["k"]
    with pytest.raises(ValueError):
        snapshots.bundle_table(spark, str(tmp_path / "b"), "run1", "t", 0)
    (tmp_path / "f").mkdir()
    (tmp_path / "f/x.bin").write_bytes(b"abc")
    before = snapshots.checksums(spark, str(tmp_path / "f"), "s", "2026", 1, "PD").collect()
    assert before[0].sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    a, b = snapshots.digest(df, ["k"]).first(), snapshots.digest(df.orderBy("v", ascending=False).select("v", "k").repartition(2), ["k"]).first()
    assert a == b and a.n == 2 and snapshots.digest(df.limit(1), ["k"]).first() != a


def test_registry(spark):
    parsers = snapshots.Registry(["a"])
    parsers.register("x")(lambda s, p: s.createDataFrame([(1, 2)], "a int, b int"))
    assert parsers.extract(spark, "x", "").columns == ["a", "parser"]
    parsers.register("y")(lambda s, p: s.createDataFrame([(1,)], "b int"))
    with pytest.raises(ValueError):
        parsers.extract(spark, "y", "")


def test_synthetic_rows_do_not_depend_on_partitions(spark):
    a = synthetic.returns(spark, 3, 2, [2020, 2022])
    assert sorted(a.collect()) == sorted(a.repartition(5).collect()) and a.count() == 36
    sums = a.groupBy("cycle", "state", "district").agg(F.sum("candidatevotes").alias("s"), F.max("totalvotes").alias("t")).collect()
    assert all(r.s == r.t for r in sums)
    assert synthetic.polls(spark.createDataFrame([("x", 0.5)], "k string, s double"), "s", 3).count() == 3


def test_names(spark):
    assert one(spark, "José  O'Brien-Núñez (Pepe) Jr.", text.token_key) == "JOSE|NUNEZ|OBRIEN"
    assert one(spark, "García, Ana", text.surname) == "GARCIA" and one(spark, "Ana María García", text.surname) == "GARCIA"
    assert one(spark, "GARCÃ\x8dA".encode("latin-1").decode("latin-1"), text.unmangled) == "GARCÍA"
    assert one(spark, "García", text.unmangled) == "García" and one(spark, "Ωmega", text.unmangled) == "Ωmega"
    assert one(spark, "WRITE-IN", text.is_person) is False and one(spark, "Ann Lee/Bo Ray", text.is_person) is True
    assert one(spark, "Democratic", text.party) == "DEMOCRAT" and one(spark, "INDEPENDENT DEMOCRAT", text.major_party) == "DEMOCRAT"
    assert one(spark, "1,234", text.whole_number) == 1234 and one(spark, "x", text.whole_number) is None
    assert one(spark, "At-Large", text.district_number) == 0 and one(spark, "SECOND DISTRICT", text.district_number) == 2 and one(spark, "District 07", text.district_number) == 7
    assert one(spark, "VII", text.roman) == 7 and one(spark, "2026-02-30", text.iso_date) is None
    assert one(spark, "http://a.b", text.https_host) is None and one(spark, "https://a.b/c", text.https_host) == "a.b"
    day = spark.createDataFrame([(2026,), (2022,)], "y int").select(calendar.election_day(F.col("y")).cast("string")).collect()
    assert [r[0] for r in day] == ["2026-11-03", "2022-11-08"]


def test_gates(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (2, 7)], "k int, v int")
    found = {r.check_name: (r.passed, r.n_bad) for r in checks.report(df, {"v": F.col("v") > 0}, ["k"]).collect()}
    assert found == {"v": (False, 1), "not_empty": (True, 0), "unique_key": (False, 1)}
    assert [r.n_bad for r in checks.depends_only_on(df, ["k"], ["v"]).collect()] == [1]
    with pytest.raises(Exception, match="broken"):
        checks.require(checks.report(df, {"v": F.col("v") > 0}), "table").collect()
    with pytest.raises(ValueError):
        checks.persistable(df, 3)
    assert checks.conformed(df, {"k": "key"}, ["key"]).columns == ["key", "v"]
    assert "w" in checks.with_defaults(df, {"w": F.lit(1), "v": F.lit(0)}).columns


def test_asof_with_ties_and_nulls(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), (None, 5), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 1, 11), ("a", 4, 12), (None, 1, 99)], "k string, t int, v int")
    got = lambda strict: sorted(((r.k, r.t, r.v) for r in joins.asof(left, right, ["k"], "t", ["v"], strict).collect()), key=str)
    assert got(False) == sorted([("a", 1, 11), ("a", 5, 12), (None, 5, None), ("b", 9, None)], key=str)
    assert got(True) == sorted([("a", 1, None), ("a", 5, 12), (None, 5, None), ("b", 9, None)], key=str)


def test_streams(spark, tmp_path):
    schema = documents.schema_of(("seat", "string"), ("seen", "timestamp"), ("votes", "int"))
    (tmp_path / "1.csv").write_text("seat,seen,votes\na,2026-01-01 00:00:00,1\na,2026-01-02 00:00:00,2\na,2026-01-02 00:00:00,2\n")
    rows = streams.observations(spark, str(tmp_path), schema, ["seat"], "seen")
    run = rows.writeStream.format("memory").queryName("seen_rows").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("seen_rows").count() == 2
    run = streams.sessions(spark.readStream.schema(schema).option("header", True).csv(str(tmp_path)), "seen", ["seat"]).writeStream.format("memory").queryName("seat_sessions").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("seat_sessions").count() >= 1
