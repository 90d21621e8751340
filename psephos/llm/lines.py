"""Line dedup by a log-template tree, in DataFrame functions only.

A line goes down a tree of fixed depth: its number of tokens, then its first ``DEPTH`` tokens, of which those with a
digit are wildcards. In a leaf, the positions at which one token holds in at least half of the lines are constant and all
others are variable fields; lines that agree with the leaf's template in at least ``AGREE`` of their positions belong to it,
each other line is a template of its own (its tokens, those with a digit as wildcards).

A template recurs if at least ``MIN_DOCS`` different texts have it, whatever else stands in them; lines of recurring
templates are dropped everywhere. Whole copies are one text, so copies of a text alone don't make its lines recur.

Only leaves with enough lines are looked at token by token. A very common line is counted by partial sums before
any shuffle; joins on its leaf may be split by Spark.

Cases: null text stays null; blank lines are never dropped; a text whose lines are all dropped is empty; tokens are
separated by single spaces after trimming; rows of one text count once and get the same result; other columns are
kept, whatever their names, but n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import named, stored

DEPTH, MIN_DOCS, AGREE = 3, 10, 0.7
WILD = "<*>"


def masked(text: Column) -> Column:
    """Every token with a digit becomes a wildcard."""
    return F.regexp_replace(text, "[^ ]*[0-9][^ ]*", WILD)


def _leaf(line: Column) -> Column:
    """The place in the tree of a line; null for blank lines. Only the leading tokens are taken apart."""
    text = F.trim(line)
    n = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1
    return F.when(text != "", F.xxhash64(n, masked(F.substring_index(text, " ", DEPTH))))


def tree_lines(docs: DataFrame) -> DataFrame:
    """A row per line that is not blank: doc_id, hash (of the text), pos, line, leaf."""
    split = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("hash"), F.split("text", "\n").alias("lines"))
    placed = split.select("doc_id", "hash", F.filter(F.transform("lines", lambda line, k: F.struct(k.alias("pos"), line.alias("line"), _leaf(line).alias("leaf"))), lambda x: x["leaf"].isNotNull()).alias("l"))
    return placed.select("doc_id", "hash", F.explode("l").alias("l")).select("doc_id", "hash", "l.*")


def templates(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The lines of leaves with at least ``min_docs`` lines and the template of each: doc_id, hash, pos, template."""
    every = tree_lines(docs)
    # Counted apart from the join, so that Spark may split a leaf with very many lines.
    leaves = stored(every.groupBy("leaf").count().where(F.col("count") >= min_docs).withColumnRenamed("count", "n_lines"), "leaves")
    lines = every.join(leaves, "leaf").withColumn("tokens", F.split(masked(F.trim("line")), " ")).drop("line")
    lines = stored(lines, "template-lines")
    # Lines of one leaf with the same tokens are counted before they are taken apart.
    alike = lines.groupBy("leaf", "tokens").agg(F.count("*").alias("c"), F.first("n_lines").alias("n_lines"))
    tokens = alike.select("leaf", "n_lines", "c", F.posexplode("tokens").alias("place", "token"))
    counted = tokens.groupBy("leaf", "place", "token").agg(F.sum("c").alias("c"), F.first("n_lines").alias("n_lines")).where(2 * F.col("c") >= F.col("n_lines"))
    constant = counted.groupBy("leaf", "place").agg(F.max(F.struct("c", "token"))["token"].alias("token"))
    known = stored(constant.groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("place", "token"))).alias("constant")), "leaf-templates")
    same = F.size(F.filter(F.transform("tokens", lambda t, k: F.coalesce(F.try_element_at("constant", k) == t, F.lit(False))), lambda x: x))
    of_leaf = same >= AGREE * F.size("tokens")
    own = F.xxhash64(F.lit("line"), F.array_join("tokens", " "))
    return lines.join(known, "leaf", "left").select("doc_id", "hash", "pos", F.when(F.coalesce(of_leaf, F.lit(False)), F.col("leaf")).otherwise(own).alias("template"))


def recurring(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The templates that at least ``min_docs`` different texts have: template, n_texts."""
    texts = found.select("hash", "template").distinct()
    return texts.groupBy("template").agg(F.count("*").alias("n_texts")).where(F.col("n_texts") >= min_docs)


def deduplicated(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The columns of ``docs`` with text less the lines of recurring templates, and n_lines and n_dropped."""
    found = stored(templates(docs, min_docs), "templates")
    drops = found.join(stored(recurring(found, min_docs), "recurring"), "template").groupBy("doc_id", "hash").agg(F.collect_set("pos").alias("drop"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # The row's own columns are kept in one, so their names can't clash.
    rows = docs.select(F.struct(*map(named, names)).alias("r"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"))
    joined = rows.join(drops, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("hash")), "left")
    lines = F.split("r.text", "\n")
    kept = F.array_join(F.filter(lines, lambda _, k: ~F.array_contains("drop", k)), "\n")
    text = F.when(F.col("drop").isNull(), F.col("r.text")).otherwise(kept).alias("text")
    counts = F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("bigint").alias("n_dropped")
    return joined.select(*(text if c == "text" else F.col("r").getField(c).alias(c) for c in names), *counts)


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, text, unnest(generate_series(0, len(lines) - 1)) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT doc_id, text, pos, list_transform(string_split(trim(line, ' '), ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{WILD}' ELSE t END) AS tokens FROM e WHERE trim(line, ' ') <> ''),
l AS (SELECT *, concat_ws(chr(1), len(tokens), tokens[1], tokens[2], tokens[3]) AS leaf FROM k),
c AS (SELECT *, count(*) OVER (PARTITION BY leaf) AS n_lines FROM l QUALIFY count(*) OVER (PARTITION BY leaf) >= {MIN_DOCS}),
p AS (SELECT leaf, n_lines, unnest(generate_series(1, len(tokens))) AS place, unnest(tokens) AS token FROM c),
q AS (SELECT leaf, place, token, count(*) AS n FROM p GROUP BY leaf, place, token, n_lines HAVING 2 * count(*) >= n_lines),
m AS (SELECT leaf, place, max({{'n': n, 'token': token}}).token AS token FROM q GROUP BY leaf, place),
s AS (SELECT c.doc_id, c.pos, count(*) AS same FROM (SELECT doc_id, pos, leaf, unnest(generate_series(1, len(tokens))) AS place, unnest(tokens) AS token FROM c) c
      JOIN m ON c.leaf = m.leaf AND c.place = m.place AND c.token = m.token GROUP BY c.doc_id, c.pos),
t AS (SELECT c.doc_id, c.text, c.pos, CASE WHEN coalesce(s.same, 0) >= {AGREE} * len(c.tokens) THEN 'leaf ' || c.leaf ELSE 'line ' || array_to_string(c.tokens, ' ') END AS template
      FROM c LEFT JOIN s ON c.doc_id = s.doc_id AND c.pos = s.pos),
r AS (SELECT template FROM t GROUP BY template HAVING count(DISTINCT text) >= {MIN_DOCS}),
x AS (SELECT t.doc_id, list(t.pos) AS drops FROM t JOIN r ON t.template = r.template GROUP BY t.doc_id)
SELECT d.doc_id,
    CASE WHEN x.drops IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(generate_series(0, len(d.lines) - 1), lambda i: NOT list_contains(x.drops, i)), lambda i: d.lines[i + 1]), chr(10)) END AS text,
    CAST(coalesce(len(d.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(x.drops), 0) AS BIGINT) AS n_dropped
FROM d LEFT JOIN x ON d.doc_id = x.doc_id
"""
