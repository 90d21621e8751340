from pyspark.sql import functions as F

from psephos.sources import canvass

TEXT = """Official Canvass
County            Deb Fischer    Dan Osborn     Write-In
                  (Republican)   (by petition)  Scatterings
Adams                  8,001          5,002            7
Box Butte  Dist 1        12                            3
  Burt                    900          801
page 2
County            Deb Fischer    Dan Osborn     Write-In
                  (Republican)   (by petition)  Scatterings
Cass                      10             20
Dawes                                    5
Total                  8,923          5,828           10"""


def lines(spark, text, doc=1):
    return spark.createDataFrame([(doc, k, line) for k, line in enumerate(text.split("\n"))], "doc int, pos int, line string")


def table(spark, text):
    found = canvass.cells(lines(spark, text), ["doc"], "pos", "line", F.col("line").rlike("^County|Republican"))
    return found, sorted((r.pos, r.label, r.name, r.value) for r in found.collect())


def test_numbers_go_to_the_column_above(spark):
    f, o, w = "Deb Fischer (Republican)", "Dan Osborn (by petition)", "Write-In Scatterings"
    found, rows = table(spark, TEXT)
    assert rows == sorted([
        (3, "Adams", f, 8001), (3, "Adams", o, 5002), (3, "Adams", w, 7),
        (4, "Box Butte Dist 1", f, 12), (4, "Box Butte Dist 1", w, 3),
        (5, "Burt", f, 900), (5, "Burt", o, 801),
        (9, "Cass", f, 10), (9, "Cass", o, 20), (10, "Dawes", o, 5),
        (11, "Total", f, 8923), (11, "Total", o, 5828), (11, "Total", w, 10),
    ])
    assert {r.name: r.passed for r in canvass.reconciled(found, ["doc"]).collect()} == {f: True, o: True, w: True}


def test_totals_that_do_not_reconcile(spark):
    found, _ = table(spark, TEXT.replace("5,828", "5,829"))
    assert sorted(r.name for r in canvass.reconciled(found, ["doc"]).where("not passed").collect()) == ["Dan Osborn (by petition)"]
    found, _ = table(spark, "\n".join(TEXT.split("\n")[:-1]))
    assert not any(r.passed for r in canvass.reconciled(found, ["doc"]).collect())


def test_full_lines_go_by_order_and_others_by_place(spark):
    text = "County      A      B      C\nRepublican\nx" + " " * 60 + "1  2  3\ny 4  5  6"
    found = canvass.cells(lines(spark, text), ["doc"], "pos", "line", F.col("line").rlike("^County"))
    assert sorted((r.label, r.name, r.value) for r in found.collect()) == [("x", "A", 1), ("x", "B", 2), ("x", "C", 3), ("y 4", "A", 5), ("y 4", "A", 6)]


def test_offsets(spark):
    found = canvass.tokens(lines(spark, "  ab c   d\n\n é  f "), ["doc"], "pos", "line")
    assert sorted((r.pos, r.token, r.start, r.end) for r in found.collect()) == [(0, "ab c", 2, 6), (0, "d", 9, 10), (2, "f", 4, 5), (2, "é", 1, 2)]
