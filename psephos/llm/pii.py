"""Personal data by patterns and by bootstrapped context.

Base: four patterns (email, ip, card, phone) with checks, leftmost and non-overlapping per kind, over whole texts.

Bootstrap: every base span is a seed entity, and so is every credential of two well-known forms, which are seeds of a
fifth kind (secret). All identifier-like strings of the texts (runs of at least ``LEAST`` characters with a digit or an @
that are no seed) are unlabelled instances. Both come with the lexical patterns of their places:

* the two words before, and the word before with the word after, where white space stands before the place;
* the name that a place is assigned to (``name=_``), where = or : stands before the place, quoted or not;
* that sign with the shape of the value (``=_ hex``), so that one name's seeds reach the values of another name.

Spark keeps a graph of patterns and instances: a row per (pattern, value) with its count; patterns of fewer than
``SUPPORT`` different values can't generalise and stay out. Reliabilities go round: a pattern's share of weight from
reliable values of a kind makes the pattern's score for the kind (shrunk by ``PRIOR``, so rare patterns stay weak), and
the mean score of its patterns makes a value's. After ``ROUNDS`` rounds, patterns of at least ``CONFIDENT`` take in the
instances in their places, if an instance is shaped like the kind. Found are these instances and the seeds of secrets.

Words and values of any length count whole: in the graph, those of more than ``LONG`` characters are named by a hash.

Cases: null text has no spans; a base span is never changed or covered by a found one, and a secret that overlaps one is
left out; one place gets at most one found kind (higher score, then the order email, ip, card, phone, secret); repeated
rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stored

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
ROUNDS, PRIOR, CONFIDENT, SUPPORT = 4, 4.0, 0.6, 5
#: Least characters of an unlabelled instance, and most of a word or value that is written out in the graph.
LEAST, LONG = 5, 64

_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# No attempt starts within a run of digits: it would fail or match just as the attempt at the run's start.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# Tried only where a run starts, so a run without a digit or @ is read once.
_LIKE = re.compile(r"(?<![^\s<>\"'=|,;])[^\s<>\"'=|,;0-9@]*+[0-9@][^\s<>\"'=|,;]*+")
_TOKEN = re.compile(r"\S+")
_MASK = re.compile(r"[0-9]+")
#: Forms of credentials whose values are seeds.
_SECRET = re.compile(r"(?<![0-9A-Za-z])(?P<key>AKIA[0-9A-Z]{16})(?![0-9A-Za-z])|(?<![0-9A-Za-z_])token ?[=:] ?[\"'](?P<value>[0-9A-Za-z_-]{20,})[\"']")
_ASSIGNED = re.compile(r"(?P<name>.*?)(?P<sign>[=:]?)[\"'(\[{]*\Z", re.S)
_HEX = re.compile(r"[0-9a-f]{12,}|[0-9A-F]{12,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` in linear time: each @ with the run before it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _TAIL.match(text, at) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start, in code points."""
    out = [("email", a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def _brief(word: str) -> str:
    return word if len(word) <= LONG else hashlib.md5(word.encode()).hexdigest()


def shape(value: str) -> str:
    """The form of a value: hex, or its runs of digits, capitals and small letters."""
    if _HEX.fullmatch(value):
        return "hex"
    return _brief(re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", _MASK.sub("0", value))))


class Places:
    """The lexical patterns of the places of one text."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [m.span() for m in _TOKEN.finditer(text)]
        self.starts = [a for a, _ in self.tokens]
        self.words: dict[int, str] = {}

    def word(self, k: int) -> str | None:
        if not 0 <= k < len(self.tokens):
            return None
        if k not in self.words:
            a, b = self.tokens[k]
            self.words[k] = _brief(_MASK.sub("0", self.text[a:b].lower()))
        return self.words[k]

    def patterns(self, start: int, end: int) -> list[str]:
        k = bisect.bisect_right(self.starts, start) - 1
        first = self.tokens[k][0]
        out = []
        if first == start:
            before, after = self.word(k - 1), self.word(bisect.bisect_left(self.starts, end))
            if before and self.word(k - 2):
                out.append(f"{self.word(k - 2)} {before} _")
            if before and after:
                out.append(f"{before} _ {after}")
        # What it is assigned to: name= in front, or name and = apart, or name= apart. Only the last pieces of the token count.
        cut = max(first, self.text.rfind(",", first, start) + 1, self.text.rfind(";", first, start) + 1)
        found = _ASSIGNED.match(self.text[max(cut, start - 2 * LONG) : start])
        name, sign = found["name"], found["sign"]
        if not name and k > 0 and cut == first:
            last = self.text[self.tokens[k - 1][1] - 1]
            if sign:
                name = self.word(k - 1)
            elif last in "=:":
                sign = last
                name = self.word(k - 1)[:-1] or self.word(k - 2) or ""
        if sign:
            if name and start - 2 * LONG < cut:
                out.append(f"{_MASK.sub('0', name.lower())}{sign}_")
            out.append(f"{sign}_ {shape(self.text[start:end])}")
        return out


def shape_fits(kind: str, value: str) -> bool:
    """Whether an unseen string may be of the kind: a looser form than the base pattern."""
    digits = sum(c in "0123456789" for c in value)
    if kind == "secret":
        return len(value) >= 12 and digits >= 3 and any(c.isalpha() for c in value) and all(c.isascii() and (c.isalnum() or c in "_-+/.~") for c in value)
    if kind == "email":
        return "@" in value.strip("@") and len(value) >= 5
    if kind == "ip":
        return digits >= 4 and all(c in "0123456789.:[]" for c in value.rstrip(".")) and value.count(".") >= 3
    if kind == "card":
        return 12 <= digits <= 19 and all(c in "0123456789-xX*" for c in value.rstrip("."))
    return 7 <= digits <= 15 and all(c in "0123456789()+-." for c in value.rstrip("."))


SPAN = "struct<kind:string,start:int,end:int>"
PLACE = "struct<kind:string,fits:array<string>,value:string,start:int,end:int,patterns:array<string>>"
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_ARROW_PLACE = pa.struct([("kind", pa.string()), ("fits", pa.list_(pa.string())), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("patterns", pa.list_(pa.string()))])


def _free(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap none of ``taken``; both are sorted."""
    out, i = [], 0
    for a, b in spans:
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i == len(taken) or taken[i][0] >= b:
            out.append((a, b))
    return out


def text_places(text: str) -> tuple[list[tuple[str, int, int]], list[dict]]:
    """The base spans of a text, and its places: seeds (with kind) and unlabelled instances (null kind)."""
    base = base_spans(text)
    if "@" not in text and "AKIA" not in text and not _DIGIT.search(text):
        return base, []
    places = Places(text)
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in base):
        ends.append(max(b, ends[-1] if ends else 0))
    taken = sorted((a, b) for _, a, b in base)
    # Spans of different kinds may overlap: running ends keep the sweep right.
    taken = [(a, e) for (a, _), e in zip(taken, ends, strict=True)]
    secrets = _free([m.span("key") if m["key"] else m.span("value") for m in _SECRET.finditer(text)], taken)
    seeds = [*base, *(("secret", a, b) for a, b in secrets)]
    found = [{"kind": k, "fits": [], "value": _brief(text[a:b]), "start": a, "end": b, "patterns": places.patterns(a, b)} for k, a, b in seeds]
    spans = []
    for m in _LIKE.finditer(text):
        value = m[0].rstrip(".:)")
        if len(value) >= LEAST:
            spans.append((m.start(), m.start() + len(value)))
    for a, b in _free(_free(spans, taken), secrets):
        value = text[a:b]
        fits = [k for k in KINDS if shape_fits(k, value)]
        if fits and (p := places.patterns(a, b)):
            found.append({"kind": None, "fits": fits, "value": _brief(value), "start": a, "end": b, "patterns": p})
    return base, found


def occurrences(docs: DataFrame) -> DataFrame:
    """row (a number of the row), doc_id, base spans, and places: seeds (with kind) and unlabelled instances (null kind)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                both = [text_places(text or "") for text in part.column("text").to_pylist()]
                spans = [[{"kind": k, "start": a, "end": b} for k, a, b in base] for base, _ in both]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "base": pa.array(spans, pa.list_(_ARROW_SPAN)), "places": pa.array([p for _, p in both], pa.list_(_ARROW_PLACE))})

    found = docs.select("doc_id", "text").mapInArrow(scan, f"doc_id bigint, base array<{SPAN}>, places array<{PLACE}>")
    return found.withColumn("row", F.monotonically_increasing_id())


def pattern_scores(places: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, score, seeds): the patterns' reliabilities after ``rounds`` rounds over the graph of ``places``.

    An edge weighs log(1 + n), so that copies of a text don't make a pattern. seeds counts different seed values.
    """
    every = places.select("kind", "value", F.explode("patterns").alias("pattern")).groupBy("pattern", "kind", "value").agg(F.log1p(F.count("*")).alias("w"))
    every = stored(every.withColumnRenamed("kind", "seed"), "pii-edges")
    # Counted apart from the join, so that Spark may split a pattern of very many values.
    general = stored(every.groupBy("pattern").agg(F.count_distinct("value").alias("n"), F.sum("w").alias("all")).where(F.col("n") >= support).drop("n"), "pii-patterns")
    edges = stored(every.join(general.select("pattern"), "pattern"), "pii-graph")
    known = edges.where("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("seeds"), F.sum("w").alias("good"))
    known = stored(known, "pii-seeds")
    unknown = edges.where("seed is null")
    score = lambda good: F.round(good / (F.col("all") + PRIOR), 9).alias("score")
    scores = known.join(general, "pattern").select("pattern", "kind", "seeds", score(F.col("good")))
    for _ in range(rounds - 1):
        instances = unknown.join(scores, "pattern").groupBy("value", "kind").agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("trust"))
        gained = unknown.join(instances, "value").groupBy("pattern", "kind").agg(F.sum(F.col("w") * F.col("trust")).alias("gain"))
        both = known.join(gained, ["pattern", "kind"], "full").join(general, "pattern")
        good = F.coalesce("good", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))
        scores = stored(both.select("pattern", "kind", F.coalesce("seeds", F.lit(0)).alias("seeds"), score(good)), "pii-scores")
    return scores


def personal_data(docs: DataFrame, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """For each row: doc_id, base (spans by kind as listed, then start) and found (seeds of secrets and spans that the bootstrap adds, likewise)."""
    seen = stored(occurrences(docs), "pii-places")
    places = seen.select("row", F.explode("places").alias("p")).select("row", "p.*")
    strong = stored(pattern_scores(places, support=support).where(F.col("score") >= confident), "pii-strong")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))

    hits = places.where("kind is null").drop("kind").select("row", "fits", "start", "end", F.explode("patterns").alias("pattern")).join(strong, "pattern")
    best = Window.partitionBy("row", "start").orderBy(F.desc("score"), order, "pattern")
    new = hits.where(F.array_contains("fits", F.col("kind"))).withColumn("rank", F.row_number().over(best)).where("rank = 1")
    seeds = places.where("kind = 'secret'")
    found = (
        new.select("row", "kind", "start", "end")
        .unionByName(seeds.select("row", "kind", "start", "end"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct(order.cast("int").alias("o"), "start", "end", "kind"))).alias("f"))
        .select("row", F.transform("f", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("found"))
    )
    return seen.join(found, "row", "left").select("doc_id", "base", F.coalesce("found", F.array().cast(f"array<{SPAN}>")).alias("found"))


def spans_text(column: str):
    """kind:start:end, by kind as listed and start, comma-joined."""
    key = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(F.transform(column, key)), line), ",")


def redacted(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id unique) with each span of ``personal_data`` replaced by its kind in angle brackets."""
    merged = spans.select("doc_id", F.array_sort(F.transform(F.concat("base", "found"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("s"))
    text = F.expr(
        """aggregate(s, struct(0 as at, '' as out),
            (a, x) -> if(x.start < a.at, a, struct(x.end as at, concat(a.out, substring(text, a.at + 1, x.start - a.at), '<', x.kind, '>') as out)),
            a -> concat(a.out, substring(text, a.at + 1)))"""
    )
    return docs.join(merged, "doc_id", "left").withColumn("text", F.coalesce(text, "text")).drop("s")
