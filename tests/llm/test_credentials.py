import re

import duckdb
import pytest

from psephos.llm import credentials, queries

ASSIGN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(?a:", "(?:"))
HEXES = "0123456789abcdef" * 3
KEY = "AKIA" + "B7" * 8

TEXTS = [
    None,
    "",
    "plain words only",
    'token = "' + HEXES + '" and é password:abc, Secret=abcdef API_KEY\'=\'"x"',
    "secret: token : abcdefgh",
    "token==abcdef tokentoken=zzzzzz passWORD   =   'ab.cd=ef-g+h/i_j'",
    f"key {KEY} short AKIA123 AKIAAKIA{'C' * 16} \U0001f600 {KEY}",
    "x" + "a" * 23 + "y" + "b" * 24 + "g0" + HEXES,
    # parts that meet
    f"user=alice uses {KEY} at https://db.example.com:5432/x now",
    "login: bob with Zx9kQ2mW7pL4 on host=db.internal",
    "login: bob with Zx9kQ2mW7pL4 and no place",
    "mail me at carol@example.com about 10.0.0.1",
    f"carol@example.com\n\npassword={'q' * 8}",
    f"carol@example.com\n \t\npassword={'q' * 8}\ndave@example.com",
    f"eve@example.com {'w ' * 150} password=qqqqqq1 {'w ' * 40} frank@example.com",
    f"{KEY} Zx9kQ2mW7pL4 10.1.2.3:80",
    f"s3cret-run-with-1-2-3 near {HEXES}",
    "https://user:pw@host/ 1.2.3.4",
]


def base(text):
    """The base patterns, plainly."""
    out = []
    for m in ASSIGN.finditer(text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            out.append((m.start(), 2, m.end(), "hex"))
    return [(k, a, b) for a, _, b, k in sorted(out)]


def candidates(text):
    for m in re.finditer(credentials.WEAK, text):
        kind = "endpoint" if re.fullmatch(credentials.ENDPOINT, m[0]) else "identifier" if re.fullmatch(credentials.IDENTIFIER, m[0]) else "secret"
        if kind != "secret" or all(re.search(x, m[0]) for x in credentials.MIXED):
            yield kind, m.start(), m.end()


def brute(text):
    """All pairs of parts, by plain loops."""
    strong = base(text)
    weak = [c for c in candidates(text) if not any(a < c[2] and c[1] < b for _, a, b in strong)]
    every = [("identifier" if k == "access" else "secret", a, b, True, k) for k, a, b in strong] + [(k, a, b, False, k) for k, a, b in weak]
    breaks = [m.start() for m in re.finditer(credentials.BREAK, text)]
    scope = lambda at: sum(x < at for x in breaks)

    def near(x, role, only=False):
        return any(y is not x and y[0] == role and (y[3] or not only) and scope(y[1]) == scope(x[1]) and max(x[1], y[1]) - min(x[2], y[2]) <= credentials.REACH for y in every)

    out = []
    for x in every:
        role = x[0]
        if role == "identifier":
            good = near(x, "secret", True) or near(x, "secret") and near(x, "endpoint")
        elif role == "secret":
            good = near(x, "identifier", True) or near(x, "identifier") and near(x, "endpoint")
        else:
            good = near(x, "identifier", True) or near(x, "secret", True) or near(x, "identifier") and near(x, "secret")
        if x[3] or good:
            out.append((x[1], credentials.KINDS.index(x[4]), x[2], x[4]))
    return [(k, a, b) for a, _, b, k in sorted(out)]


def spans(row):
    return sorted(((s.start, credentials.KINDS.index(s.kind), s.end, s.kind) for s in [*row.base, *row.found]))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(1000 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    return rows + [rows[8], (None, TEXTS[9]), (5000, "word " * 200_000 + TEXTS[8])]


def test_same_as_brute_force(spark, docs):
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, row string, kind int")
    found = credentials.secret_scan(frame).collect()
    plain = lambda rows: sorted(rows, key=str)
    assert plain((r.doc_id, [(k, a, b) for a, _, b, k in spans(r)]) for r in found) == plain((d, brute(t or "")) for d, t in docs)
    assert plain((r.doc_id, [(s.kind, s.start, s.end) for s in r.base]) for r in found) == plain((d, base(t or "")) for d, t in docs)
    assert sum(len(r.found) for r in found) > 8


def test_credentials_name_the_parts(spark):
    text = TEXTS[9]
    r = credentials.secret_scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    at = lambda s: text[s.start : s.end]
    assert [tuple(map(at, c)) for c in r.credentials] == [("Zx9kQ2mW7pL4", "login: bob", "host=db.internal")]


def test_same_as_sql(spark, docs, tmp_path):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = db.execute(credentials.ORACLE_SQL)
    names = [d[0] for d in wanted.description]
    found = queries.op11_secret_scan(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, found), key=str) == sorted(wanted.fetchall(), key=str)


def test_runs_without_a_match_take_linear_time(spark):
    texts = ["a" * 300_000, "token " * 50_000, "token" + " " * 300_000, "1." * 100_000, "a." * 100_000, "AKIA" * 80_000, "\n" * 100_000, "x://" * 60_000, "secret=ab " * 20_000]
    rows = credentials.secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert len(rows) == len(texts)


def test_no_python_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert credentials.secret_scan(none).collect() == []
