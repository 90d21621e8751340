"""Text expressions: names, codes, identifiers, parties. All are built-in column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters() -> dict[str, str]:
    """Characters whose compatibility decomposition has one ASCII letter or digit, to it; and some letters that have none."""
    plain = {c: "".join(x for x in unicodedata.normalize("NFKD", c) if x < "\x80") for c in map(chr, [*range(0x80, 0xD800), *range(0xF900, 0x10000)])}
    return {c: x for c, x in plain.items() if len(x) == 1 and x.isalnum()} | {"ł": "l", "Ł": "L", "ı": "i"}


_LETTERS = _plain_letters()
#: The ligatures that fonts leave in extracted names.
_LIGATURES = {"ﬁ": "fi", "ﬂ": "fl"}
#: Words in ballot names that are no part of a name.
NOISE = ("MR", "MRS", "MS", "MISS", "DR", "PHD", "MD", "ESQ", "HON", "REV", "JR", "SR", "II", "III", "IV", "V", "REP", "SEN", "THE")
#: Entries of returns that are no persons.
NOT_PERSONS = (
    "", "ALL OTHERS", "BLANK", "BLANK VOTE", "BLANK VOTES", "BLANKS", "EXHAUSTED BALLOT", "EXHAUSTED BALLOTS", "NAN", "NONE OF THESE CANDIDATES",
    "OTHER", "OTHER WRITE-INS", "OTHERS", "OVER VOTE", "OVER VOTES", "OVERVOTE", "OVERVOTES", "SCATTER", "SCATTERED", "SCATTERING", "SPOILED", "TOTAL",
    "UNDER VOTE", "UNDER VOTES", "UNDERVOTE", "UNDERVOTES", "VOID", "VOID VOTE", "VOID VOTES", "WRITE-IN", "WRITE-INS", "WRITEIN", "WRITEINS",
)
#: Labels of each party, matched as a whole.
PARTY_LABELS = {
    "DEMOCRAT": (
        "D", "DEM", "DEMOCRAT", "DEMOCRATIC", "DEMOCRATIC PARTY", "DEMOCRATIC PARTY NOMINEES", "DEMOCRAT (NOT IDENTIFIED ON BALLOT)",
        "DFL", "DEMOCRATIC-FARMER-LABOR", "DEMOCRATIC-FARM-LABOR", "DEMOCRATIC-NONPARTISAN LEAGUE", "DEMOCRATIC-NPL", "DNL",
    ),
    "REPUBLICAN": ("R", "REP", "REPUBLICAN", "REPUBLICAN PARTY", "REPUBLICAN (NOT IDENTIFIED ON BALLOT)", "GOP", "INDEPENDENT REPUBLICAN", "INDEPENDENT REPUBLICAN PARTY"),
    "LIBERTARIAN": ("LIB", "LIBERTARIAN", "LIBERTARIAN PARTY"),
    "GREEN": ("GRE", "GREEN", "GREEN PARTY"),
    "INDEPENDENT": ("IND", "INDEPENDENT", "INDEPENDENTS", "NPA", "NO PARTY AFFILIATION", "NO PARTY PREFERENCE", "NOP", "UN", "UNA", "UNAFFILIATED", "NON", "NON-PARTY"),
    "OTHER": ("NNE", "NONE", "OTH", "OTHER"),
    "UNKNOWN": ("NAN", ""),
}
MAJOR = ("DEMOCRAT", "REPUBLICAN")
#: Labels that hold a major party's name and are not it.
NOT_MAJOR = ("DEMOCRATIC SOCIALIST", "NATIONAL DEMOCRATIC PARTY OF ALABAMA", "NATIONAL DEMOCRAT", "DEMOCRAT/REPUBLICAN", "UNAFFILIATED/REPUBLICAN")
#: Ordinals of districts; those behind TWENTIETH are put together from tens and units.
_UNITS = ("FIRST", "SECOND", "THIRD", "FOURTH", "FIFTH", "SIXTH", "SEVENTH", "EIGHTH", "NINTH")
_TEENS = ("TENTH", "ELEVENTH", "TWELFTH", "THIRTEENTH", "FOURTEENTH", "FIFTEENTH", "SIXTEENTH", "SEVENTEENTH", "EIGHTEENTH", "NINETEENTH")
_TENS = ("TWENT", "THIRT", "FORT", "FIFT")
ORDINALS = (*_UNITS, *_TEENS, *(word for ten in _TENS for word in (f"{ten}IETH", *(f"{ten}Y-{unit}" for unit in _UNITS))))


def squeezed(x: Column) -> Column:
    """Upper case, single spaces."""
    return F.upper(F.trim(F.regexp_replace(x, r"\s+", " ")))


def folded(x: Column) -> Column:
    """Letters without marks, by compatibility decomposition; the ligatures fi and fl are spelled out, what has no plain letter is dropped."""
    # x stands here once: expressions of names hold this one several times.
    out = F.translate(x, "".join(_LETTERS), "".join(_LETTERS.values()))
    for letter, plain in _LIGATURES.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return F.regexp_replace(out, r"[^\x00-\x7F]", "")


def unmangled(x: Column) -> Column:
    """UTF-8 that was read as Latin-1, read anew; unchanged where that is not what happened."""
    fits = F.coalesce(~x.rlike(r"[^\x00-\xFF]"), F.lit(False))
    raw = F.encode(F.when(fits, x), "ISO-8859-1")
    return F.when(fits & F.is_valid_utf8(F.try_validate_utf8(raw.cast("string"))), raw.cast("string")).otherwise(x)


def letters(x: Column) -> Column:
    """Capital letters only: a key for comparing names."""
    return F.regexp_replace(F.upper(folded(x)), "[^A-Z]", "")


#: Nicknames: in double quotes, straight or curly, in brackets, or in single quotes that stand apart.
NICKNAME = "[\"\u201c][^\"\u201c\u201d]*[\"\u201d]|(?<![^\\s])['\u2018][^'\u2018\u2019]*['\u2019](?![^\\s])|\\([^)]*\\)"


def name_tokens(x: Column) -> Column:
    """The words of a name longer than a letter, without nicknames in quotes or brackets, titles and suffixes.

    An apostrophe joins what stands on both sides; words read in a wrong charset are mended first.
    """
    bare = F.regexp_replace(F.replace(unmangled(x), F.lit("\\"), F.lit("")), NICKNAME, " ")
    plain = F.upper(folded(F.regexp_replace(bare, "['\u2018\u2019\u02bc\u00b4`]", "")))
    words = F.split(F.trim(F.regexp_replace(plain, "[^A-Z]+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*NOISE))


def surname(x: Column) -> Column:
    """The last word of what stands before a comma, or of all."""
    return F.try_element_at(name_tokens(F.substring_index(x, ",", 1)), F.lit(-1))


def first_name(x: Column) -> Column:
    """The first word of what stands behind a comma, or of all."""
    return F.try_element_at(name_tokens(F.substring_index(x, ",", -1)), F.lit(1))


def token_key(x: Column) -> Column:
    """The words in alphabetical order: the same for both orders of a name."""
    return key_of(name_tokens(x))


def key_of(words: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(words)), "|")


def surname_variants(x: Column) -> Column:
    """The surname (of a double name the last part), and the last two words together."""
    return variants_of(name_tokens(F.substring_index(x, ",", 1)))


def variants_of(words: Column) -> Column:
    """The variants of a surname from the words before the comma."""
    joined = F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2), "")
    return F.array_distinct(F.filter(F.array(F.try_element_at(words, F.lit(-1)), F.when(F.size(words) >= 2, joined)), lambda v: v.isNotNull()))


def is_person(x: Column) -> Column:
    """False for entries that are no persons: as a whole, or in all parts that slashes separate."""
    return ~F.forall(F.split(F.coalesce(squeezed(x), F.lit("")), "/"), lambda p: F.trim(p).isin(*NOT_PERSONS))


def party(x: Column) -> Column:
    """The party by exact label; OTHER for labels of none, UNKNOWN for null and blank ones."""
    label = F.coalesce(squeezed(x), F.lit(""))
    known = F.create_map(*[F.lit(v) for name, labels in PARTY_LABELS.items() for one in labels for v in (one, name)])
    return F.coalesce(F.try_element_at(known, label), F.lit("OTHER"))


def ballot_party(raw: Column, simplified: Column, filed: Column) -> Column:
    """A struct (value, source): the party on the ballot from the returns' label, their simplified label and a filing.

    A major party by the label, then by the simplified one, then any party of the filing, then a minor party of the two
    labels, then OTHER where the simplified label has it.
    """
    a, b, c = party(raw), party(simplified), party(filed)
    minor = lambda p: ~p.isin("UNKNOWN", "OTHER")
    steps = [(a.isin(*MAJOR), a, "raw"), (b.isin(*MAJOR), b, "simplified"), (minor(c), c, "filed"), (minor(a), a, "raw"), (minor(b), b, "simplified"), (b != "UNKNOWN", b, "simplified")]
    value = source = None
    for test, v, name in steps:
        value = F.when(test, v) if value is None else value.when(test, v)
        source = F.when(test, name) if source is None else source.when(test, name)
    return F.struct(value.otherwise("UNKNOWN").alias("value"), source.otherwise("unresolved").alias("source"))


def bucket(x: Column) -> Column:
    """D, R or OTHER."""
    return F.when(party(x) == "DEMOCRAT", "D").when(party(x) == "REPUBLICAN", "R").otherwise("OTHER")


def major_party(x: Column) -> Column:
    """The major party that a label contains, null where it contains none or both, or is a party of its own."""
    label = squeezed(x)
    own = label.isin(*NOT_MAJOR)
    d, r = label.contains("DEMOCRAT") & ~own, label.contains("REPUBLICAN") & ~own
    return F.when(d & ~r, "DEMOCRAT").when(r & ~d, "REPUBLICAN")


def first_known(candidates: Sequence[tuple[str, Column]]) -> Column:
    """A struct (value, source) of the first value that is known."""
    value = F.coalesce(*(c for _, c in candidates))
    source = None
    for name, c in candidates:
        source = F.when(c.isNotNull(), name) if source is None else source.when(c.isNotNull(), name)
    return F.struct(value.alias("value"), source.alias("source"))


def flag(x: Column) -> Column:
    """TRUE, T, YES, Y and 1 are true, all else false."""
    return F.coalesce(F.upper(F.trim(x)).isin("TRUE", "T", "YES", "Y", "1"), F.lit(False))


def strict_flag(x: Column) -> Column:
    """True or false by these words only; anything else is null."""
    word = F.lower(F.trim(x))
    return F.when(word == "true", True).when(word == "false", False)


def whole_number(x: Column) -> Column:
    """An integer with thousands' commas; null if it is none."""
    return F.trim(F.replace(x, F.lit(","), F.lit(""))).try_cast("bigint")


def padded(x: Column, width: int) -> Column:
    """A code as digits with leading zeros; one that is longer stays."""
    s = F.trim(x.cast("string"))
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def precinct_code(x: Column) -> Column:
    """A precinct code without leading zeros, upper case, from behind the last dash or blank; zeros alone are 0."""
    tail = F.regexp_extract(squeezed(x), r"([A-Z0-9.]+)\s*$", 1)
    return F.when(tail == "", None).when(tail.rlike("^0+$"), "0").otherwise(F.regexp_replace(tail, "^0+", ""))


def district_number(x: Column) -> Column:
    """A district as an integer: at-large labels are 0, ordinals and digits count, anything else is null."""
    label = squeezed(x)
    words = F.array(*map(F.lit, ORDINALS))
    ordinal = F.array_position(words, F.regexp_replace(F.regexp_extract(label, "^((?:TWENTY|THIRTY|FORTY|FIFTY)[- ][A-Z]+|[A-Z]+)", 1), " ", "-")).cast("int")
    return F.when(label.rlike("^(AT[- ]LARGE|STATEWIDE|AL)$"), 0).otherwise(F.coalesce(F.regexp_extract(label, r"(\d+)", 1).try_cast("int"), F.nullif(ordinal, F.lit(0))))


def roman(x: Column) -> Column:
    """Roman numerals I to X as integers."""
    return F.nullif(F.array_position(F.array(*map(F.lit, ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"))), F.upper(F.trim(x))).cast("int"), F.lit(0))


def race_id(cycle: Column, office: Column, state: Column, district: Column, stage: Column, special: Column, runoff: Column) -> Column:
    """cycle_office_state[_dd]_stage[_special][_runoff]."""
    return F.concat_ws("_", cycle.cast("string"), office, state, F.lpad(district.cast("string"), 2, "0"), stage, F.when(special, "special"), F.when(runoff, "runoff"))


def geography_id(fips: Column, district: Column) -> Column:
    """state:FF or state:FF|district:cong_DD; no state: nation:us."""
    state = F.concat(F.lit("state:"), padded(fips, 2))
    return F.when(fips.isNull(), "nation:us").when(district.isNull(), state).otherwise(F.concat(state, F.lit("|district:cong_"), F.lpad(district.cast("string"), 2, "0")))


def id_suffix(x: Column) -> Column:
    return F.substring_index(x, "_", -1)


def https_host(x: Column) -> Column:
    """The host of an https address, null for anything else."""
    return F.when(F.try_parse_url(x, F.lit("PROTOCOL")) == "https", F.try_parse_url(x, F.lit("HOST")))


def iso_date(x: Column) -> Column:
    """A date that is written YYYY-MM-DD and exists, else null."""
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), x.try_cast("date"))


def contest(x: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """A struct (office, district) of the first (office, pattern) that a title matches; group 1, if there, is the district."""
    office = district = None
    for name, pattern in patterns:
        hit = x.rlike(pattern)
        number = F.regexp_extract(x, pattern, 1).try_cast("int") if "(" in pattern.replace("(?", "") else F.lit(None).cast("int")
        office = F.when(hit, name) if office is None else office.when(hit, name)
        district = F.when(hit, number) if district is None else district.when(hit, number)
    return F.struct(office.alias("office"), district.alias("district"))
