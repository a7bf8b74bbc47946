import hashlib
import re

from conftest_llm import HARD
from pyspark.sql import functions as F

from assay.llm import fingerprint


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, out, slack):
    order = sorted(rows, key=lambda r: -r[0])
    by = {r.doc_id: r for r in out}
    assert len(by) == len(rows)
    for k, (doc, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        r = by[doc]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(text), shingles(edited), shingles(after)
        assert abs(r.near_edited - likeness(a, b)) <= (1e-9 if len(a | b) <= fingerprint.K else slack)
        assert abs(r.near_next - likeness(a, c)) <= (1e-9 if len(a | c) <= fingerprint.K else slack)


def test_unique_hard_rows(frame):
    rows = [(k, r[1]) for k, r in enumerate(HARD)]
    check(rows, fingerprint.fingerprints(frame(rows)).collect(), 0.2)


def test_single_and_empty_table(frame):
    check([(5, "one two three four five six")], fingerprint.fingerprints(frame([(5, "one two three four five six")])).collect(), 0)
    assert fingerprint.fingerprints(frame([])).collect() == []


def test_null_and_repeated_ids_keep_every_row(frame):
    out = fingerprint.fingerprints(frame(HARD)).collect()
    assert len(out) == len(HARD)
    by_text = {}
    for r in out:
        by_text.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)


def test_query_against_brute_force(spark, data):
    from assay.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, QUERIES["op10_fingerprint"](spark, data).collect(), 0.2)


def test_parts_merge_to_the_whole(spark, frame):
    words = [f"w{k}" for k in range(4000)]
    whole, a, b = " ".join(words), " ".join(words[:2004]), " ".join(words[2000:])
    df = frame([(1, whole), (2, a), (3, b)]).select("doc_id", fingerprint.sketch(F.col("text")).alias("s"))
    s = {r.doc_id: r.s for r in df.collect()}
    one = spark.createDataFrame([(s[2], s[3], s[1])], "a array<long>, b array<long>, c array<long>")
    got = one.select(fingerprint.merge(F.col("a"), F.col("b")).alias("m"), fingerprint.distinct_shingles(F.col("c")).alias("n"), fingerprint.containment(F.col("a"), F.col("c")).alias("in")).first()
    assert got.m == s[1] and abs(got.n - 3996) < 1200 and got["in"] > 0.8
    grouped = fingerprint.merged(df.filter("doc_id > 1").withColumn("g", F.lit(1)), ["g"], "s").first()
    assert grouped.s == s[1]


def test_no_python_in_the_plan(frame):
    plan = fingerprint.fingerprints(frame(HARD))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)
