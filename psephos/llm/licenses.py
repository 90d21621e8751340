"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

A header is any line of a file, wherever it stands, any sentence of a line, or a block: up to ``BLOCK_LINES`` lines with
strong cues (cue terms but for stop words) in a row, at most one other line between two of them, so wrapped notices
count as one text. A licence file is one with a licence file's name; it is compared as a whole and by its headers.
Both are compared with all templates by the cosine of TF-IDF vectors (weights from the templates; a term that no
template has weighs as one that a single template has), by joins of terms in Spark. One pass over the texts sends only
parts there that reach the threshold up to rounding, by the same vectors in NumPy for lines and sentences and term by
term for blocks, so nothing is lost. A run of cued lines whose terms hold too little of each template's length has no
block that reaches it.

A file's licence is that of its best header, else that of the licence file in the nearest directory above it, found by
joining the file's ancestor directories with the directories of licence files. Terms ignore the case of A-Z only; a
text that shares a single term with a template doesn't state its licence.

Cases: null text states nothing; null path has no directory and inherits nothing; several licences in a file or
directory: the highest cosine, then the name, but "All rights reserved." only where nothing else is found, as
licensed files say so too; a tie of a header and an inherited licence can't be, as headers win;
no files give no rows; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stored
from .words import LOWER, slices, word_bounds, word_hashes

THRESHOLD = 0.6
#: The name of what reserves all rights.
RESERVED_NAME = "Proprietary"

#: Usual short notices of well-known licences, by SPDX name (a name may have several).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited. All rights reserved."),
]

TERM = "[a-z0-9]+(?:\\.[0-9]+)*"
#: Words that any English text has; as cues they come last.
STOP_WORDS = frozenset("a all an and any are as at be by can either for from has have in is it may met not of on or other that the this to under use v with without work you your".split())
#: A notice that licensed files have too: it gives way to any other.
RESERVED = ["all", "rights", "reserved"]
BLOCK_LINES = 12
SENTENCE_END = "(?<=[.!?;]) +(?=[A-Z])"
FILE_NAMES = "(?i)^(un)?licen[cs]e|^copying|^notice"


_AZ = {k: k + 32 for k in range(65, 91)}
#: Terms begin with runs of these bytes, once A-Z are small letters.
_RUNS = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.translate(_AZ))


def _small(text: str | Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def template_weights(templates: list[tuple[str, str]]) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, licence, term, weight of unit length), the idf of each term, and the idf of all other terms."""
    bags = [Counter(terms(t)) for _, t in templates]
    df = Counter(t for bag in bags for t in bag)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
    out = []
    for k, ((name, _), bag) in enumerate(zip(templates, bags, strict=True)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        out += [(k, name, t, n * idf[t] / norm) for t, n in sorted(bag.items())]
    return out, idf, math.log((1 + len(bags)) / 2) + 1


def cue_terms(weights: list[tuple[int, str, str, float]], threshold: float) -> list[str]:
    """Terms without any of which no text reaches the threshold.

    The cosine with a template is at most the length of the template's part in the terms that both have; terms are
    taken until that part, over all other terms, is below the threshold for each template.
    """
    out: set[str] = set()
    for k in {w[0] for w in weights}:
        own = sorted(((w, t) for j, _, t, w in weights if j == k), key=lambda x: (x[1] in STOP_WORDS, -x[0], x[1]))
        rest = sum(w * w for w, t in own if t not in out)
        for w, t in own:
            if rest < (threshold * 0.999) ** 2:
                break
            if t not in out:
                out.add(t)
                rest -= w * w
    return sorted(out)


def _best(texts: DataFrame, key: str, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """The best (key, license, cosine) of each key over its rows (key, part, text) that reaches the threshold."""
    spark = texts.sparkSession
    weights, idf, other = template_weights(templates)
    weak = [k for k, (_, t) in enumerate(templates) if terms(t) == RESERVED]
    # Both tables are as large as the templates, which are given by the caller's program.
    table = spark.createDataFrame(weights, "template int, license string, term string, w double")
    idfs = spark.createDataFrame(list(idf.items()), "term string, idf double")
    found = texts.select(key, "part", F.explode(F.regexp_extract_all(_small("text"), F.lit(f"({TERM})"), 1)).alias("term"))
    bag = found.groupBy(key, "part", "term").agg(F.count("*").alias("n")).join(F.broadcast(idfs), "term", "left")
    bag = bag.withColumn("x", F.col("n") * F.coalesce("idf", F.lit(other)))
    norm = bag.groupBy(key, "part").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dot = bag.join(F.broadcast(table), "term").groupBy(key, "part", "template", "license").agg(F.sum(F.col("x") * F.col("w")).alias("dot"), F.count("*").alias("shared")).where("shared > 1")
    scored = dot.join(norm, [key, "part"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("cosine") >= threshold)
    best = F.min(F.struct(F.col("template").isin(weak).alias("weak"), (-F.col("cosine")).alias("c"), "license"))
    return scored.groupBy(key).agg(best.alias("b")).select(key, F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


class Bound:
    """What a text may reach at most, vectorised over many texts, and the exact cosine of one.

    Vectorised, terms are told by the hashes of their runs of letters and digits. A term with a dot is several runs, so
    texts with such terms are judged by their shared weight alone: for each template the sum of squared weights of the
    terms that both have, in which terms that begin alike are added up, so it is never too small.
    """

    def __init__(self, weights: list[tuple[int, str, str, float]], idf: dict[str, float], other: float, threshold: float):
        self.threshold, self.least = threshold - 1e-6, (threshold * 0.999) ** 2
        n = max(w[0] for w in weights) + 1
        self.weights: dict[str, np.ndarray] = {}
        for k, _, t, w in weights:
            self.weights.setdefault(t, np.zeros(n))[k] += w
        self.idf, self.other = idf, other
        strong = [c for c in cue_terms(weights, threshold) if c not in STOP_WORDS]
        self.strong = re.compile(f"(?<![a-z0-9])(?:{'|'.join(map(re.escape, strong))})(?![a-z0-9])")
        heads: dict[str, np.ndarray] = {}
        for t, v in self.weights.items():
            heads[t.split(".")[0]] = heads.get(t.split(".")[0], np.zeros(n)) + v * v
        data = np.frombuffer(" ".join(heads).encode(), np.uint8)
        starts, ends, _ = word_bounds(data, np.array([0, len(data)]), _RUNS)
        hashes = word_hashes(data, starts, ends)
        order = np.argsort(hashes)
        names = np.array(list(heads))[order].tolist()
        self.hashes, self.squares = hashes[order], np.array(list(heads.values()))[order]
        self.plain = np.array([self.weights.get(t, np.zeros(n)) for t in names])
        self.plain_idf = np.array([idf.get(t, other) for t in names])
        self.is_strong = np.isin(names, [c.split(".")[0] for c in strong])

    def cosine(self, bag: Mapping[str, int]) -> float:
        """The greatest cosine of a bag of terms with a template."""
        x = {t: n * self.idf.get(t, self.other) for t, n in bag.items()}
        shared = [v * self.weights[t] for t, v in x.items() if t in self.weights]
        return float(np.sum(shared, axis=0).max() / math.sqrt(sum(v * v for v in x.values()))) if shared else 0.0

    def reached(self, text: str) -> bool:
        return self.cosine(Counter(terms(text))) >= self.threshold

    def cued(self, text: str) -> bool:
        return self.strong.search(text.translate(_AZ)) is not None


class Terms:
    """The runs of letters and digits of some texts: their byte offsets, codes, and places in the bound's table (or -1)."""

    def __init__(self, bound: Bound, data: np.ndarray, ends: np.ndarray):
        self.bound = bound
        small = LOWER[data]
        self.start, stops, _ = word_bounds(small, ends, _RUNS)
        codes, self.code = np.unique(word_hashes(small, self.start, stops), return_inverse=True)
        at = np.minimum(np.searchsorted(bound.hashes, codes), len(bound.hashes) - 1)
        self.of_code = np.where(bound.hashes[at] == codes, at, -1) if len(codes) else np.zeros(0, np.int64)
        self.table = self.of_code[self.code]
        inner = np.flatnonzero((small[1:-1] == 46) & _RUNS[small[:-2]] & (small[2:] >= 48) & (small[2:] <= 57)) + 1 if len(small) > 2 else np.zeros(0, np.int64)
        self.dots = inner

    def shared(self, group: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
        """Which of n groups of table entries hold enough of a template."""
        size = np.int64(len(self.bound.hashes))
        pairs = np.unique(group * size + table)
        group, table = pairs // size, pairs % size
        most = np.zeros(n)
        for k in range(self.bound.squares.shape[1]):
            most = np.maximum(most, np.bincount(group, self.bound.squares[table, k], n))
        return most >= self.bound.least

    def reaching(self, breaks: np.ndarray) -> np.ndarray:
        """Which of the pieces that begin at ``breaks`` may reach the threshold."""
        n, size = len(breaks), np.int64(max(1, len(self.of_code)))
        group = np.searchsorted(breaks, self.start, "right") - 1
        pairs, count = np.unique(group * size + self.code, return_counts=True)
        of, table = pairs // size, self.of_code[pairs % size]
        known = np.flatnonzero(table >= 0)
        x = count * self.bound.other
        x[known] = count[known] * self.bound.plain_idf[table[known]]
        norm = np.sqrt(np.bincount(of, x * x, n))
        best = np.zeros(n)
        for k in range(self.bound.plain.shape[1]):
            best = np.maximum(best, np.bincount(of[known], x[known] * self.bound.plain[table[known], k], n))
        good = best >= self.bound.threshold * np.maximum(norm, 1e-9)
        dotted = np.unique(np.searchsorted(breaks, self.dots, "right") - 1)
        if len(dotted):
            own = np.flatnonzero(np.isin(group, dotted) & (self.table >= 0))
            good[dotted] |= self.shared(group[own], self.table[own], n)[dotted]
        return good & (norm > 0)


def _blocks(lines: Mapping[int, str], bound: Bound) -> Iterator[str]:
    """The blocks of cued lines that reach the threshold."""
    at = [k for k in sorted(lines) if bound.cued(lines[k])]
    bags = [Counter(terms(lines[k])) for k in at]
    for i in range(len(at)):
        bag = Counter(bags[i])
        for j in range(i + 1, min(len(at), i + BLOCK_LINES)):
            if at[j] - at[j - 1] > 2:
                break
            bag += bags[j]
            if bound.cosine(bag) >= bound.threshold:
                yield " ".join(lines[k] for k in at[i : j + 1])


def headers(texts: DataFrame, bound: Bound) -> DataFrame:
    """The lines, sentences and blocks of (_row, text) that may be headers: _row, part (a hash of the text), text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in slices(batches):
            breaks = np.union1d(np.flatnonzero(data == 10) + 1, ends)
            breaks = breaks[breaks < len(data)]  # where lines begin; an empty last line is none
            if not len(breaks):
                continue
            found = Terms(bound, data, ends)
            # Sentences begin with a capital letter behind spaces behind an end mark.
            solid = np.maximum.accumulate(np.where(data != 32, np.arange(len(data)), -1))
            capital = np.flatnonzero((data[1:] >= 65) & (data[1:] <= 90) & (data[:-1] == 32)) + 1
            capital = capital[(solid[capital - 1] >= 0) & np.isin(data[solid[capital - 1]], list(b".!?;"))]
            pieces = np.union1d(breaks, capital)
            line_of_piece = np.searchsorted(breaks, pieces, "right") - 1
            good = found.reaching(breaks)
            good[line_of_piece[found.reaching(pieces)]] = True

            line = np.searchsorted(breaks, found.start, "right") - 1
            text_of = np.searchsorted(ends, breaks, "right") - 1
            known = found.table >= 0
            cued = np.unique(line[known][bound.is_strong[found.table[known]]])
            in_run = np.zeros(len(breaks), bool)
            if len(cued):
                # Lines with cues, at most one other between two of them, are a run.
                apart = np.ones(len(cued), bool)
                apart[1:] = (np.diff(cued) > 2) | (np.diff(text_of[cued]) > 0)
                run = np.full(len(breaks), -1)
                run[cued] = np.cumsum(apart) - 1
                inside = np.flatnonzero(known & (run[line] >= 0))
                whole = found.shared(run[line[inside]], found.table[inside], int(apart.sum())) & (np.bincount(run[cued]) > 1)
                in_run[cued] = whole[run[cued]]
            chosen: dict[int, dict[int, str]] = {}
            stops = np.append(breaks[1:], len(data))
            for k in np.flatnonzero(good | in_run).tolist():
                raw = data[breaks[k] : stops[k]].tobytes().decode()
                chosen.setdefault(int(text_of[k]), {})[k] = raw.removesuffix("\n")
            rows, out = [], []
            for i, lines in chosen.items():
                texts: dict[str, None] = {}
                for k in lines:
                    if good[k]:
                        sentences = (t for t in re.split(SENTENCE_END, lines[k]) if bound.cued(t))
                        texts.update((t, None) for t in [lines[k], *sentences] if bound.reached(t))
                texts.update((t, None) for t in _blocks({k: t for k, t in lines.items() if in_run[k]}, bound))
                rows += [i] * len(texts)
                out += texts
            if out:
                yield pa.record_batch({"_row": part.column("_row").take(pa.array(rows)), "text": pa.array(out, pa.string())})

    return texts.mapInArrow(scan, "_row bigint, text string").select("_row", F.xxhash64("text").alias("part"), "text")


def _reaching(texts: DataFrame, bound: Bound) -> DataFrame:
    """The rows of (key, part, text) whose whole texts may reach the threshold."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in slices(batches):
            starts = np.unique(ends[:-1][np.diff(ends) > 0])
            good = np.zeros(len(part), bool)
            if len(starts):
                good[np.flatnonzero(np.diff(ends) > 0)] = Terms(bound, data, ends).reaching(starts)
            yield part.filter(pa.array(good))

    return texts.mapInArrow(scan, texts.schema)


def _parents(path: Column) -> Column:
    """The directories above a path, the nearest first, with "" as the root."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.size(steps) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))


def effective_licenses(files: DataFrame, key: str = "path", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, elect: bool = False) -> DataFrame:
    """For each row of ``files`` (key, path, text): key, license, cosine, origin (header, file, inherited or none) and source_dir.

    With ``elect``, a directory without a licence file's name has its plainest statement for one: the file whose header has the
    highest cosine, reservations of all rights last, then the smallest key.
    """
    templates = templates or TEMPLATES
    rows = files.select(F.col(key).alias("key"), "path", "text").withColumn("_row", F.xxhash64("key", "path", "text"))
    is_file = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(FILE_NAMES), F.lit(False))
    heads = headers(rows.select("_row", "text"), Bound(*template_weights(templates), threshold))
    whole = rows.where(is_file).select("_row", F.xxhash64("text").alias("part"), "text")
    direct = stored(_best(heads.unionByName(whole).dropDuplicates(["_row", "part"]), "_row", templates, threshold), "licenses")

    facts = rows.select("_row", "key", "path", is_file.alias("is_file"))
    own = facts.join(direct, "_row", "left")
    folder = F.col("parents")[0]
    if elect:
        plain = own.where("path is not null").withColumn("folder", _parents(F.col("path"))[0])
        rank = F.struct((F.col("license") == RESERVED_NAME).alias("w"), (-F.col("cosine")).alias("c"), "key", "_row")
        best = plain.groupBy("folder").agg(F.max("is_file").alias("named"), F.min(F.when(F.col("license").isNotNull(), rank)).alias("b"))
        elected = stored(best.where("not named and b is not null").select(F.col("b._row").alias("_row"), F.lit(True).alias("_elected")), "elected-files")
        own = own.join(elected, "_row", "left").withColumn("is_file", F.col("is_file") | F.coalesce("_elected", F.lit(False))).drop("_elected")
    stated = own.where("is_file and license is not null and path is not null").withColumn("parents", _parents(F.col("path"))).select(folder.alias("dir"), "license", "cosine")
    stated = stated.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b")).select("dir", F.col("b.license").alias("dir_license"), (-F.col("b.c")).alias("dir_cosine"))
    # Directories are few next to files: inheritance is found once per directory and joined back.
    folders = facts.where("path is not null").select(_parents(F.col("path")).alias("parents")).select(folder.alias("folder"), "parents").distinct()
    nearest = stored(
        folders.select("folder", F.posexplode("parents").alias("up", "dir"))
        .join(stated, "dir")
        .groupBy("folder")
        .agg(F.min(F.struct("up", "dir", "dir_license", "dir_cosine")).alias("n"))
        .select("folder", F.col("n.dir").alias("dir"), "n.dir_license", "n.dir_cosine"),
        "licence-directories",
    )  # apart from the join, so that Spark may split a directory with very many files
    joined = own.withColumn("folder", _parents(F.col("path"))[0]).join(nearest, "folder", "left")
    origin = F.when(F.col("license").isNotNull(), F.when(F.col("is_file"), F.lit("file")).otherwise(F.lit("header"))).when(F.col("dir_license").isNotNull(), F.lit("inherited")).otherwise(F.lit("none"))
    return joined.select(
        F.col("key").alias(key),
        F.coalesce("license", "dir_license", F.lit("none")).alias("license"),
        F.coalesce("cosine", "dir_cosine", F.lit(0.0)).alias("cosine"),
        origin.alias("origin"),
        F.when(F.col("license").isNull(), F.col("dir")).alias("source_dir"),
    )


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql() -> str:
    """DuckDB SQL for the query over documents, with the templates and the threshold of this module."""
    small = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    strong = "|".join(re.escape(c) for c in cue_terms(template_weights(TEMPLATES)[0], THRESHOLD) if c not in STOP_WORDS)
    cued = f"regexp_matches({small('text')}, '(^|[^a-z0-9])({strong})([^a-z0-9]|$)')"
    bag = f"(SELECT {{0}}, term, count(*) AS n FROM (SELECT {{0}}, unnest(regexp_extract_all({small('text')}, '{TERM}')) AS term FROM {{1}}) GROUP BY ALL)".format
    best = "min({{'weak': weak, 'c': -cosine, 'license': license}})".replace("{{", "{").replace("}}", "}")

    def scored(key: str, rows: str) -> str:
        """(key, weak, license, cosine) of the rows' texts that reach the threshold."""
        return f"""(SELECT {key}, weak, license, cosine FROM (
            SELECT {key}, text, k, round(sum(x * w) / max(norm), 9) AS cosine FROM (
                SELECT {key}, text, term, n * coalesce(idf, other) AS x, sqrt(sum((n * coalesce(idf, other)) ** 2) OVER (PARTITION BY {key}, text)) AS norm
                FROM {bag(f"{key}, text", f"(SELECT DISTINCT {key}, text FROM {rows})")} b LEFT JOIN idf USING (term), o) x JOIN tw USING (term) GROUP BY {key}, text, k HAVING count(*) > 1) z
            JOIN t USING (k) WHERE cosine >= {THRESHOLD})"""

    return f"""
WITH t(k, license, text, weak) AS (VALUES {", ".join(f"({k}, {_sql_text(n)}, {_sql_text(x)}, {terms(x) == RESERVED})" for k, (n, x) in enumerate(TEMPLATES))}),
tb AS {bag("k", "t")},
idf AS (SELECT term, ln((1 + {len(TEMPLATES)}) / (1 + count(*))) + 1 AS idf FROM tb GROUP BY term),
o AS (SELECT ln((1 + {len(TEMPLATES)}) / 2) + 1 AS other),
tw AS (SELECT k, term, n * idf / sqrt(sum((n * idf) ** 2) OVER (PARTITION BY k)) AS w FROM tb JOIN idf USING (term)),
d AS (SELECT doc_id, text, concat_ws('/', source, lang) AS folder, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(generate_series(1, len(lines))) AS pos, unnest(lines) AS text FROM d),
c AS (SELECT * FROM l WHERE {cued}),
r AS (SELECT *, row_number() OVER w AS i, sum(fresh) OVER w AS run FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 2 THEN 0 ELSE 1 END AS fresh FROM c) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
b AS (SELECT x.doc_id, string_agg(m.text, ' ' ORDER BY m.i) AS text FROM r x JOIN r y ON x.doc_id = y.doc_id AND x.run = y.run AND y.i > x.i AND y.i < x.i + {BLOCK_LINES}
    JOIN r m ON m.doc_id = x.doc_id AND m.i BETWEEN x.i AND y.i GROUP BY x.doc_id, x.i, y.i),
s AS (SELECT doc_id, text FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?;]) +([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS text FROM c) WHERE {cued}),
p AS (SELECT doc_id, text FROM l UNION ALL SELECT doc_id, text FROM s UNION ALL SELECT doc_id, text FROM b),
h AS (SELECT doc_id, {best} AS b FROM {scored("doc_id", "p")} GROUP BY doc_id),
g AS (SELECT d.doc_id, d.folder, h.b.license AS license, -h.b.c AS cosine FROM d LEFT JOIN h USING (doc_id)),
w AS (SELECT *, license IS NOT NULL AND row_number() OVER (PARTITION BY folder ORDER BY license IS NULL, license = '{RESERVED_NAME}', cosine DESC, doc_id) = 1 AS is_file FROM g),
v AS (SELECT folder, min({{'c': -cosine, 'license': license}}) AS b FROM w WHERE is_file AND license IS NOT NULL GROUP BY folder)
SELECT w.doc_id, coalesce(w.license, v.b.license, 'none') AS license, coalesce(w.cosine, -v.b.c, 0.0) AS cosine,
    CASE WHEN w.license IS NOT NULL THEN CASE WHEN is_file THEN 'file' ELSE 'header' END WHEN v.folder IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
    CASE WHEN w.license IS NULL THEN v.folder END AS source_dir
FROM w LEFT JOIN v ON w.folder = v.folder
"""
