"""Secret scan with multipart credential linking, in DataFrame functions only.

Base: three patterns (assign, access, hex), leftmost and non-overlapping per kind, over whole texts, in code points.

Parts of credentials have a role: an identifier says who, a secret proves it, an endpoint says where. Base matches are
strong parts (access: identifier; assign and hex: secret). Weak candidates are e-mail addresses and assigned user names
(identifiers), mixed runs of letters and digits (secrets), and URLs, IP addresses and assigned hosts (endpoints). Blank
lines cut a text into scopes. Within a scope each part is joined with the nearest parts of other roles whose intervals,
widened by ``REACH`` characters, meet its own: the parts are sorted once and carry the farthest end before and the first
start behind them, per role, so no pairs are made whatever the number of parts. A weak candidate is reported only if

* an identifier has a strong secret in reach, or a weak secret and an endpoint;
* a secret has a strong identifier in reach, or a weak identifier and an endpoint;
* an endpoint has a strong part in reach, or a weak identifier and a weak secret.

Weak candidates that overlap a base match are left out. Secrets are linked to the nearest reported identifier and
endpoint in reach, as credentials.

Positions come from one pass of each pattern: ``(.*?)(pattern|end)`` gives every match with the gap before it, and sums of
their lengths give the offsets. Parts are spread by row, so a common text or source is no hot key.

Cases: null text has no matches; repeated rows give repeated results; texts of any length are scanned whole, in time
linear in the text for runs without a match; null doc_id is kept; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stored

BASE_KINDS = ("assign", "access", "hex")
ROLES = ("identifier", "secret", "endpoint")
KINDS = (*BASE_KINDS, *ROLES)
#: Characters between parts of one credential at most.
REACH = 200


def _either(words: str) -> str:
    """ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def _assigned(names: str, value: str) -> str:
    return rf"""(?:{_either(names)})["']?\x20*[:=]\x20*["']?{value}"""


#: The base patterns. Runs of hex digits and of what follows AKIA are maximal, so their least length is part of the pattern.
_VALUE = "[A-Za-z0-9+/_.=-]"
_NAMES = "password|passwd|secret|token|api_?key"
ASSIGN = _assigned(_NAMES, f"{_VALUE}+")
ASSIGN_LONG = f"^{_assigned(_NAMES, _VALUE + '{6,}')}$"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"

ENDPOINT = rf"""[A-Za-z][A-Za-z0-9+.-]{{1,15}}://[^\x00-\x20"'<>]+|[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?::[0-9]{{1,5}})?|{_assigned("hostname|host|endpoint|server|url", "[A-Za-z0-9._:/-]+")}"""
IDENTIFIER = rf"""[A-Za-z0-9._%+-]{{1,64}}@[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}})+|{_assigned("username|user|login|account|client_?id|key_?id", "[A-Za-z0-9._%+@-]+")}"""
#: Runs, and those of them that are mixed enough for a candidate: three digits and three letters somewhere.
RUN = "[A-Za-z0-9+/_-]{12,}={0,2}"
MIXED = "^(?:[^0-9]*[0-9]){3}", "^(?:[^A-Za-z]*[A-Za-z]){3}"
WEAK = f"{ENDPOINT}|{IDENTIFIER}|{RUN}"
BREAK = r"\n[\x20\t\r]*\n"


def _pieces(text: Column, kind: Column | str, pattern: str, good=lambda hit: F.lit(True)) -> Column:
    """For each match its kind, number, the characters of the gap before it and its own, and whether it counts; the last piece is the rest."""
    found = lambda group: F.regexp_extract_all(text, F.lit(f"(?s)(.*?)({pattern}|\\z)"), F.lit(group))
    of = (lambda hit: F.lit(kind)) if isinstance(kind, str) else kind
    one = lambda p, k: F.struct(of(p["hit"]).alias("kind"), k.alias("k"), F.length(p["gap"]).alias("gap"), F.length(p["hit"]).alias("n"), ((p["hit"] != "") & good(p["hit"])).alias("good"))
    pieces = F.transform(F.arrays_zip(found(1).alias("gap"), found(2).alias("hit")), one)
    return F.when(text.rlike(pattern), pieces).otherwise(F.array().cast("array<struct<kind:string,k:int,gap:int,n:int,good:boolean>>"))


def _weak_kind(hit: Column) -> Column:
    return F.when(hit.rlike(f"^(?:{ENDPOINT})$"), "endpoint").when(hit.rlike(f"^(?:{IDENTIFIER})$"), "identifier").otherwise("secret")


def scanned(docs: DataFrame) -> DataFrame:
    """row (a number of the row), doc_id, and pieces: the matches of all patterns, without the text."""
    text = F.coalesce("text", F.lit(""))
    anchored = text.rlike(f"{ASSIGN}|{ACCESS}|{HEX}|{ENDPOINT}")  # no weak candidate counts without a strong part or an endpoint
    none = F.lit(None).cast("string")
    weak = F.when(anchored, text).otherwise(none)
    mixed = lambda hit: (_weak_kind(hit) != "secret") | (hit.rlike(MIXED[0]) & hit.rlike(MIXED[1]))
    weak_pieces = F.transform(_pieces(weak, _weak_kind, WEAK, mixed), lambda p: p.withField("kind", F.concat(F.lit("weak "), p["kind"])))
    pieces = F.concat(
        _pieces(text, "assign", ASSIGN, lambda hit: hit.rlike(ASSIGN_LONG)),
        _pieces(text, "access", ACCESS),
        _pieces(text, "hex", HEX),
        weak_pieces,
        F.when(anchored, _pieces(weak, "break", BREAK)).otherwise(F.array()),
    )
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", pieces.alias("pieces"))


def parts(scan: DataFrame) -> DataFrame:
    """row, kind, start, end (code points) of all matches that count, breaks among them."""
    each = scan.select("row", F.explode("pieces").alias("p")).select("row", "p.*")
    # The weak patterns are one pass, whose pieces have several kinds.
    by_pass = F.when(F.col("kind").startswith("weak "), F.lit("weak")).otherwise(F.col("kind"))
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("row", by_pass).orderBy("k")).cast("int")
    return each.withColumn("end", end).where("good").select("row", F.regexp_replace("kind", "^weak ", "").alias("kind"), (F.col("end") - F.col("n")).alias("start"), "end")


def _near(which: Column, among: Window, reach: int) -> Column:
    """Whether a part that ``which`` tells lies in reach, before or behind."""
    before = F.max(F.when(which, F.col("end"))).over(among.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(which, F.col("start"))).over(among.rowsBetween(1, Window.unboundedFollowing))
    return F.coalesce(before + reach >= F.col("start"), F.lit(False)) | F.coalesce(behind <= F.col("end") + reach, F.lit(False))


def reported(found: DataFrame, reach: int = REACH) -> DataFrame:
    """row, kind, start, end, scope, role of base matches and of the weak candidates whose complements are in reach."""
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    scope = F.sum((F.col("kind") == "break").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    base = F.col("kind").isin(*BASE_KINDS)
    covered = _near(base, order, -1)  # at least one character in common
    role = F.when(F.col("kind") == "access", "identifier").when(base, "secret").otherwise(F.col("kind"))
    placed = found.withColumns({"scope": scope, "role": role, "strong": base, "covered": covered}).where("kind != 'break' and (strong or not covered)")
    among = Window.partitionBy("row", "scope").orderBy("start", "end", "kind")
    identifier, secret, endpoint = ((F.col("role") == r) for r in ROLES)
    near = {
        "strong_id": _near(identifier & F.col("strong"), among, reach),
        "some_id": _near(identifier, among, reach),
        "strong_secret": _near(secret & F.col("strong"), among, reach),
        "some_secret": _near(secret, among, reach),
        "place": _near(endpoint, among, reach),
    }
    kept = """strong or case role when 'identifier' then strong_secret or some_secret and place
        when 'secret' then strong_id or some_id and place
        else strong_id or strong_secret or some_id and some_secret end"""
    return placed.withColumns(near).where(kept).select("row", "kind", "start", "end", "scope", "role")


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """The parts with identifier and endpoint: for a secret the nearest (start, end) of each in reach and scope, the one before it among equals."""
    among = Window.partitionBy("row", "scope").orderBy("start", "end", "kind")
    out = {}
    for role in ("identifier", "endpoint"):
        own = F.when(F.col("role") == role, F.struct("end", "start"))
        before = F.max(own).over(among.rowsBetween(Window.unboundedPreceding, -1))
        behind = F.min(F.when(F.col("role") == role, F.struct("start", "end"))).over(among.rowsBetween(1, Window.unboundedFollowing))
        gap_before = F.when(before.isNotNull(), F.greatest(F.col("start") - before["end"], F.lit(0)))
        gap_behind = F.when(behind.isNotNull(), F.greatest(behind["start"] - F.col("end"), F.lit(0)))
        best = F.when(gap_before <= F.coalesce(gap_behind, gap_before), F.struct(gap_before.alias("gap"), before["start"].alias("start"), before["end"].alias("end"))).otherwise(
            F.struct(gap_behind.alias("gap"), behind["start"].alias("start"), behind["end"].alias("end"))
        )
        out[role] = F.when((F.col("role") == "secret") & (best["gap"] <= reach), F.struct(best["start"].alias("start"), best["end"].alias("end")))
    return found.withColumns(out)


def secret_scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """For each row: doc_id, base and found (spans by start, then kind as listed), and credentials (secret, identifier, endpoint).

    ``docs`` need doc_id and text.
    """
    scan = stored(scanned(docs), "secret-pieces")
    kept = linked(reported(parts(scan), reach), reach)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct("start", order.alias("o"), "end", "kind")
    base = F.col("kind").isin(*BASE_KINDS)
    pair = F.struct(F.struct("start", "end").alias("secret"), "identifier", "endpoint")
    lists = kept.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(base, span))).alias("b"),
        F.array_sort(F.collect_list(F.when(~base, span))).alias("f"),
        F.array_sort(F.collect_list(F.when(F.col("identifier").isNotNull() | F.col("endpoint").isNotNull(), pair))).alias("c"),
    )
    plain = lambda c: F.coalesce(F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    place = "struct<start:int,end:int>"
    credentials = F.coalesce("c", F.array().cast(f"array<struct<secret:{place},identifier:{place},endpoint:{place}>>"))
    return scan.select("row", "doc_id").join(lists, "row", "left").select("doc_id", plain("b").alias("base"), plain("f").alias("found"), credentials.alias("credentials"))


def spans_text(*columns: str) -> Column:
    """kind:start:end of the spans by start, then kind as listed, comma-joined."""
    key = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind"))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(F.transform(F.concat(*columns), key)), line), ",")


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_pieces(name: str, pattern: str, where: str) -> str:
    whole = _sql(f"(?s)(.*?)({pattern}|\\z)")
    return f"""(SELECT r, {name} AS pass, unnest(generate_series(1, len(g))) AS k, unnest(g) AS gap, unnest(h) AS hit FROM
        (SELECT r, regexp_extract_all(t, {whole}, 1) AS g, regexp_extract_all(t, {whole}, 2) AS h FROM d WHERE {where}))"""


def _sql_near(which: str, reach: int, by: str) -> str:
    order = f"(PARTITION BY {by} ORDER BY s, e, kind ROWS BETWEEN"
    return f"""(coalesce(max(CASE WHEN {which} THEN e END) OVER {order} UNBOUNDED PRECEDING AND 1 PRECEDING) + {reach} >= s, false)
        OR coalesce(min(CASE WHEN {which} THEN s END) OVER {order} 1 FOLLOWING AND UNBOUNDED FOLLOWING) <= e + {reach}, false))"""


_STRONG = "kind IN ('assign', 'access', 'hex')"
_ORDER = "list_position(['assign', 'access', 'hex', 'identifier', 'secret', 'endpoint'], kind)"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT r FROM d WHERE regexp_matches(t, {_sql(f"{ASSIGN}|{ACCESS}|{HEX}|{ENDPOINT}")})),
p AS (SELECT * FROM {_sql_pieces("'assign'", ASSIGN, "true")} UNION ALL SELECT * FROM {_sql_pieces("'access'", ACCESS, "true")} UNION ALL SELECT * FROM {_sql_pieces("'hex'", HEX, "true")}
    UNION ALL SELECT * FROM {_sql_pieces("'weak'", WEAK, "r IN (FROM a)")} UNION ALL SELECT * FROM {_sql_pieces("'break'", BREAK, "r IN (FROM a)")}),
q AS (SELECT r, pass, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY r, pass ORDER BY k) AS e FROM p),
m AS (SELECT r, CAST(e - length(hit) AS BIGINT) AS s, CAST(e AS BIGINT) AS e,
        CASE WHEN pass <> 'weak' THEN pass WHEN regexp_matches(hit, {_sql(f"^(?:{ENDPOINT})$")}) THEN 'endpoint' WHEN regexp_matches(hit, {_sql(f"^(?:{IDENTIFIER})$")}) THEN 'identifier' ELSE 'secret' END AS kind, hit
    FROM q WHERE hit <> '' AND (pass <> 'assign' OR regexp_matches(hit, {_sql(ASSIGN_LONG)}))),
n AS (SELECT *, sum(CASE WHEN kind = 'break' THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s, e, kind ROWS UNBOUNDED PRECEDING) AS scope, {_sql_near(_STRONG, -1, "r")} AS covered
    FROM m WHERE kind <> 'secret' OR regexp_matches(hit, {_sql(MIXED[0])}) AND regexp_matches(hit, {_sql(MIXED[1])})),
o AS (SELECT *, {_STRONG} AS strong, CASE WHEN kind = 'access' THEN 'identifier' WHEN {_STRONG} THEN 'secret' ELSE kind END AS role FROM n WHERE kind <> 'break' AND ({_STRONG} OR NOT covered)),
x AS (SELECT *, {_sql_near("role = 'identifier' AND strong", REACH, "r, scope")} AS si, {_sql_near("role = 'identifier'", REACH, "r, scope")} AS i, {_sql_near("role = 'secret' AND strong", REACH, "r, scope")} AS ss,
    {_sql_near("role = 'secret'", REACH, "r, scope")} AS c, {_sql_near("role = 'endpoint'", REACH, "r, scope")} AS p FROM o),
y AS (SELECT r, kind, s, strong, kind || ':' || s || ':' || e AS label FROM x WHERE strong OR CASE role WHEN 'identifier' THEN ss OR (c AND p) WHEN 'secret' THEN si OR (i AND p) ELSE si OR ss OR (i AND c) END),
z AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE NOT strong) AS n_found,
    string_agg(label, ',' ORDER BY s, {_ORDER}) FILTER (WHERE strong) AS base, string_agg(label, ',' ORDER BY s, {_ORDER}) AS spans FROM y GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_found, 0) AS n_found
FROM d LEFT JOIN z ON d.r = z.r
"""
