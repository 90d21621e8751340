import math
import re
import textwrap
from collections import Counter

import duckdb

from psephos.llm import licenses, queries


def cosine(text, template, idf, other):
    a, b = (Counter(licenses.terms(t)) for t in (text, template))
    va, vb = ({t: n * idf.get(t, other) for t, n in x.items()} for x in (a, b))
    return sum(v * vb.get(t, 0) for t, v in va.items()) / math.sqrt(sum(v * v for v in va.values()) * sum(v * v for v in vb.values())) if va else 0


def test_cues_lose_nothing():
    weights, idf, other = licenses.template_weights(licenses.TEMPLATES)
    cues = set(licenses.cue_terms(weights, licenses.THRESHOLD))
    for _, template in licenses.TEMPLATES:
        rest = " ".join(t for t in licenses.terms(template) if t not in cues)
        assert cosine(rest, template, idf, other) < licenses.THRESHOLD


def test_headers_files_and_inheritance(spark):
    rows = [
        ("a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
        ("a/x.py", "print(1)"),
        ("a/b/c/y.py", "some text\nLicensed under the Apache License, Version 2.0.\nmore"),
        ("a/b/c/z.py", None),
        ("a/d/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        ("a/d/e/f.py", ""),
        ("q.py", "x " * 30000),
        (None, "All rights reserved."),
        ("a/x.py", "print(1)"),
    ]
    d = spark.createDataFrame([(p, t, "n") for p, t in rows], "path string, text string, license string")
    found = sorted(((r.path, r.license, r.origin, r.source_dir) for r in licenses.effective_licenses(d).collect()), key=str)
    assert found == sorted(
        [
            ("a/LICENSE", "MIT", "file", None),
            ("a/x.py", "MIT", "inherited", "a"),
            ("a/x.py", "MIT", "inherited", "a"),
            ("a/b/c/y.py", "Apache-2.0", "header", None),
            ("a/b/c/z.py", "MIT", "inherited", "a"),
            ("a/d/COPYING.txt", "GPL-3.0", "file", None),
            ("a/d/e/f.py", "GPL-3.0", "inherited", "a/d"),
            ("q.py", "none", "none", None),
            (None, "Proprietary", "header", None),
        ],
        key=str,
    )
    assert licenses.effective_licenses(d.limit(0)).collect() == []


GPL = next(t for name, t in licenses.TEMPLATES if name == "GPL-3.0" and len(t) > 100)
APACHE = max((t for name, t in licenses.TEMPLATES if name == "Apache-2.0"), key=len)


def test_wrapped_and_combined_headers(spark):
    rows = [
        ("gpl72.py", "\n".join("# " + x for x in textwrap.wrap(GPL, 72)), "GPL-3.0"),
        ("gpl30.py", "import os\n" + textwrap.fill(GPL, 30) + "\n\nprint(1)", "GPL-3.0"),
        ("two.py", "Copyright 2024 Foo Inc. All rights reserved. Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("both.py", "// Copyright 2024 Foo Inc. All rights reserved.\n//\n" + textwrap.fill(APACHE, 60), "Apache-2.0"),
        ("own.py", "Copyright 2024 Foo Inc. All rights reserved.", "Proprietary"),
        ("apart.py", "\n\n\n".join(textwrap.wrap(APACHE, 12)), "none"),
        ("word.py", "Das ist so.\nMit.\nEs", "none"),
        ("prose.py", "The end of the tale.\nIt may not be the same to all.", "none"),
    ]
    d = spark.createDataFrame([r[:2] for r in rows], "path string, text string")
    assert {r.path: r.license for r in licenses.effective_licenses(d).collect()} == {p: n for p, _, n in rows}


def brute(docs):
    weights, idf, other = licenses.template_weights(licenses.TEMPLATES)
    strong = set(licenses.cue_terms(weights, licenses.THRESHOLD)) - licenses.STOP_WORDS

    def best(texts):
        found = [(licenses.terms(t) == licenses.RESERVED, -round(c, 9), n) for x in texts for n, t in licenses.TEMPLATES if len(set(licenses.terms(x)) & set(licenses.terms(t))) > 1 and (c := cosine(x, t, idf, other)) >= licenses.THRESHOLD]
        return (min(found)[2], -min(found)[1]) if found else None

    def parts(text):
        lines = text.split("\n")
        yield from lines
        for line in lines:
            yield from (x for x in re.split(licenses.SENTENCE_END, line) if strong & set(licenses.terms(x)))
        at = [k for k, x in enumerate(lines) if strong & set(licenses.terms(x))]
        for i in range(len(at)):
            for j in range(i + 1, min(len(at), i + licenses.BLOCK_LINES)):
                if at[j] - at[j - 1] > 2:
                    break
                yield " ".join(lines[k] for k in at[i : j + 1])

    own_of = {i: best(parts(text or "")) for i, text, *_ in docs}
    plainest = {}
    for i, _, lang, source in docs:
        if own_of[i]:
            rank = own_of[i][0] == licenses.RESERVED_NAME, -own_of[i][1], i
            plainest[source, lang] = min(plainest.get((source, lang), rank), rank)
    is_file = {i: plainest.get((source, lang), (0, 0, None))[2] == i for i, _, lang, source in docs}
    folders = {}
    for i, _, lang, source in docs:
        if is_file[i] and own_of[i]:
            folders.setdefault(f"{source}/{lang}", []).append((-own_of[i][1], own_of[i][0]))
    out = []
    for i, _, lang, source in docs:
        own, folder = own_of[i], f"{source}/{lang}"
        if own:
            out.append((i, own[0], "file" if is_file[i] else "header", None))
        elif folder in folders:
            out.append((i, min(folders[folder])[1], "inherited", folder))
        else:
            out.append((i, "none", "none", None))
    return sorted(out)


def test_query_inherits_from_licence_documents(spark, tmp_path):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    docs = [tuple(r) for r in real] + [
        (90006, "Copyright 2024 Foo Inc. All rights reserved.\nReleased under the MIT License.", "fr", "src9"),
        (90007, "x. All rights reserved. Y", "fr", "src9"),
        (90001, "A.\nReleased under the MIT License.", "en", "src1"),
        (90002, "Licensed under the Apache License, Version 2.0.", "de", "src2"),
        (90003, "All rights reserved.\n" * 100, "fr", "src3"),
        (90004, None, "en", "src1"),
        (90005, textwrap.fill(GPL, 50) + "\nwords " * 200, "en", "src1"),
    ]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((r.doc_id, r.license, r.origin, r.source_dir) for r in queries.op3_license_scan(spark, str(tmp_path)).collect())
    assert found == brute(docs)
    assert {o for _, _, o, _ in found} == {"file", "header", "inherited", "none"}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    by_sql = db.execute(f"SELECT doc_id, license, origin, source_dir FROM ({queries.ORACLES['op3_license_scan']})").fetchall()
    assert sorted(by_sql) == found
