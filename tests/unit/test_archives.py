import random
import zipfile

import pytest
from pyspark.sql import functions as F

from psephos.sources import archives, documents


def test_many_members_are_many_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("dir/", "")
        for k in range(7):
            z.writestr(f"dir/m{k}.txt", f"x{k}\r\ny\n\nlast", zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
        z.writestr("other.bin", b"\x00\x01")
        z.writestr("empty.txt", "")
    found = archives.read(spark, "ziplines", f"{tmp_path}/a.zip", pattern=r".*\.txt")
    assert found.rdd.getNumPartitions() == 8
    rows = sorted((r.member, r.pos, r.line) for r in found.collect())
    assert rows == sorted((f"dir/m{k}.txt", i, line) for k in range(7) for i, line in enumerate((f"x{k}", "y", "", "last")))
    parts = {(r.member, r.piece): bytes(r.content) for r in archives.read(spark, "zipmembers", f"{tmp_path}", pattern="other.bin|empty.txt").collect()}
    assert parts == {("other.bin", 0): b"\x00\x01", ("empty.txt", 0): b""}
    assert archives.read(spark, "ziplines", f"{tmp_path}/a.zip", pattern="none").collect() == []


def test_a_large_member_streams(spark, tmp_path, monkeypatch):
    """A member far larger than a piece comes in pieces, lines across their edges and wide characters included."""
    rng = random.Random(1)
    texts = ["é" * rng.randrange(40) + str(rng.random()) for _ in range(60_000)]
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.csv", "\n".join(texts) + "\n")
    (member,) = archives.members(f"{tmp_path}/b.zip")
    monkeypatch.setattr(archives, "PIECE", 1000)
    assert max(map(len, archives.pieces(member))) <= 1000
    assert list(archives.lines(member)) == texts
    found = archives.read(spark, "ziplines", f"file:{tmp_path}/b.zip").agg(F.count("*").alias("n"), F.max("pos").alias("m"), F.sum(F.length("line")).alias("c")).first()
    assert (found.n, found.m, found.c) == (60_000, 59_999, sum(map(len, texts)))


def test_damage_is_told(tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("m", b"hello world")
    raw = bytearray((tmp_path / "c.zip").read_bytes())
    raw[raw.index(b"hello")] ^= 1
    (tmp_path / "c.zip").write_bytes(raw)
    with pytest.raises(ValueError, match="damaged"):
        list(archives.pieces(archives.members(f"{tmp_path}/c.zip")[0]))


SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def test_sheets_by_title(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{REL}"><sheets><sheet name="Votes" r:id="a"/><sheet name="Notes" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Name</t></si><si><r><t>Vo</t></r><r><t>tes</t></r></si></sst>')
        rows = "".join(f'<row r="{k}"><c r="A{k}" t="inlineStr"><is><t>p{k}</t></is></c><c r="AB{k}"><v>{k * 10}</v></c><c r="AC{k}"/></row>' for k in range(2, 9000))
        z.writestr("xl/worksheets/s1.xml", SHEET.format('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row>' + rows))
        z.writestr("xl/worksheets/s2.xml", SHEET.format('<row r="1"><c r="A1"><v>9</v></c></row>'))
    found = documents.sheet_cells(spark, f"{tmp_path}/w.xlsx", "Votes")
    table = documents.with_header(found.drop("path"), ["sheet"], 1, ["Name", "Votes"])
    assert table.count() == 8998 and sorted(table.where("row < 4").select("name", "votes").collect()) == [("p2", "20"), ("p3", "30")]
    assert [tuple(r)[1:] for r in documents.sheet_cells(spark, f"{tmp_path}", "Notes").collect()] == [("Notes", 1, 1, "9")]


def test_written_archives_are_read_back(spark, tmp_path):
    rows = [(f"a{k % 3}.zip", f"m{k}", f"text {k}\né") for k in range(20)]
    archives.write_archives(spark.createDataFrame(rows, "archive string, member string, content string"), f"{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a0.zip", "a1.zip", "a2.zip"]
    found = archives.read(spark, "ziplines", f"{tmp_path}/out").where("pos = 0").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.member, r.line) for r in found) == sorted((a, m, t.split("\n")[0]) for a, m, t in rows)
