import math
import random
import re

from conftest_llm import HARD

from assay.llm import license_scan
from assay.llm.license_texts import BSD, GPL, GPL_GRANT, ISC, MIT, TEMPLATES, ZLIB

PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for label, p in PHRASES.items() for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    "MIT License and the Apache-License, GNU General Public License v3",
    "mit mit license license mit licenses",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this excellent software and associated documentation files",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Licensed under CC BY-NC 4.0.",
    "general public general public license " * 300,
    "MİT license ß mit license",
    "the license of the mit",
]
#: Scraps of licenses that are none.
SCRAPS = ["of the " * 30, "you may " * 40, "the license " * 30, "this software " * 20 + "free of " * 3, "by the " * 19, "of this software and " * 200, "the implied warranties of " * 90]


def distance(a, b):
    line = list(range(len(b) + 1))
    for x in a:
        new = [line[0] + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, line[j + 1] + 1, line[j] + (x != y)))
        line = new
    return line[-1]


def best_cover(text, template):
    """The largest share of a template's words that stand in order in a window of the text, its two slacks longer, over all windows."""
    clean = lambda t: re.sub(r"[^0-9a-z]+", " ", t.lower()).split()
    words, tpl = clean(text), clean(template)
    slack = math.ceil(license_scan.SLACK * len(tpl))
    size = len(tpl) + 2 * slack
    padded = ["."] * size + words + ["."] * size
    return max(max(0, 1 - (distance(padded[k : k + size], tpl) - 2 * slack) / len(tpl)) for k in range(len(words) + size))


def test_base_and_method(frame):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100 + k, r[1]) for k, r in enumerate(HARD)]
    out = {r.doc_id: r for r in license_scan.scan(frame(rows)).collect()}
    assert len(out) == len(rows)
    for doc, text in rows:
        r = out[doc]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert out[2].labels == "mit" and out[3].labels == "bsd" and out[4].labels == "cc-by-nc" and out[7].labels == ""


def test_scraps_are_no_license(frame):
    for r in license_scan.scan(frame(list(enumerate(SCRAPS)))).collect():
        assert (r.labels, r.n_base) == ("", 0) and r.score < 0.5, (r.doc_id, r)


def test_texts_with_words_put_in_left_out_and_changed(frame):
    rng, rows, wanted = random.Random(5), [], {}
    for label, text in (("mit", MIT), ("bsd", BSD), ("isc", ISC), ("zlib", ZLIB), ("gpl", GPL), ("gpl", GPL_GRANT)):
        for kind in range(4):
            words = text.split()
            for _ in range(max(1, len(words) // 25) if kind else 0):
                at = rng.randrange(3, len(words) - 3)
                words[at : at + (kind != 1)] = {1: ["indeed"], 2: [], 3: ["other"]}[kind]
            rows.append((len(rows), "some words before " * rng.randrange(40) + " ".join(words) + " and after"))
            wanted[rows[-1][0]] = label
    out = {r.doc_id: r for r in license_scan.scan(frame(rows)).collect()}
    assert all(label in out[k].labels.split(",") for k, label in wanted.items()), {k: (v, out[k].labels, out[k].score) for k, v in wanted.items() if v not in out[k].labels}
    assert all(out[k].score == 1 for k in wanted if k % 4 == 0)


def test_cover_against_all_windows(frame):
    """Texts with ever more words changed: what all windows hold is what the merged diagonals find, where triples still vote."""
    rng, label, template = random.Random(8), "gpl", GPL_GRANT
    rows = []
    for n in range(12):
        words = template.split()
        for at in rng.sample(range(len(words)), n):
            words[at] = "changed"
        rows.append((n, "a line before it " + " ".join(words) + " a line after it"))
    out = {r.doc_id: r for r in license_scan.spans(frame(rows)).filter(f"label = '{label}' and tpl = {[t[1] for t in TEMPLATES].index(template)}").groupBy("doc_id").agg({"cover": "max"}).collect()}
    for n, text in rows:
        exact = best_cover(text, template)
        got = out[n][1] if n in out else 0.0
        assert got <= exact + 1e-9 and (exact < license_scan.COVER or got >= license_scan.COVER - 0.1), (n, exact, got)


def test_repeated_rows_and_empty_table(frame):
    assert license_scan.scan(frame(HARD)).count() == len(HARD)
    assert license_scan.scan(frame([])).collect() == []


def test_no_python_in_the_plan(frame):
    plan = license_scan.scan(frame(HARD))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_matches_sql(spark, data, duck):
    from compare import same_rows

    from assay.llm.queries import ORACLES, QUERIES

    assert same_rows(QUERIES["op6_license_scan"](spark, data).toPandas(), duck.sql(ORACLES["op6_license_scan"]).df())


def test_sql_agrees_on_whole_texts(frame):
    import duckdb
    from compare import same_rows

    words = MIT.split()
    rows = [(1, MIT), (2, " ".join(words[:50] + ["indeed"] + words[50:])), (3, " ".join(words[:80] + words[90:])), (4, GPL + " and " + GPL_GRANT), (5, "x " * 40 + " ".join(words[:100])), *((10 + k, t) for k, t in enumerate(SCRAPS))]
    docs = frame(rows)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert same_rows(license_scan.scan(docs).toPandas(), con.sql(license_scan.oracle()).df())
