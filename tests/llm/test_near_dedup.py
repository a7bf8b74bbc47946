import random

from conftest_llm import HARD

import corpus_pipeline
from assay.llm import near_dedup, simhash


def slow_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def slow_kept(rows):
    """Ids that stay, by comparing each text with each; ids are distinct."""
    sets, root = {i: slow_shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in sets.items():
        for g in s or {()}:
            holders.setdefault(g, []).append(i)
    seen = set()
    for some in holders.values():
        for k, a in enumerate(some):
            for b in some[:k]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                        root[max(top(a), top(b))] = min(top(a), top(b))
    return {top(i) for i in root}


def planted():
    """Texts of 200 words with copies in which 1 to 9 words were changed; a chain; and a group with outsiders."""
    rng, rows = random.Random(5), []
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    for _ in range(12):
        plain = [word() for _ in range(200)]
        rows.append((len(rows), " ".join(plain)))
        for changes in range(1, 10):
            other = list(plain)
            for at in rng.sample(range(200), changes):
                other[at] = word()
            rows.append((len(rows), " ".join(other)))
    link = [word() for _ in range(200)]
    for _ in range(8):
        link[rng.randrange(200)] = word()
        rows.append((len(rows), " ".join(link)))
    return rows


def test_stage_drops_what_is_alike_though_fingerprints_differ(spark, frame, data):
    rows = planted()
    first, other = rows[0][1], rows[3][1]
    assert (simhash.fingerprint(first) ^ simhash.fingerprint(other)).bit_count() > 2
    got = {r.doc_id for r in corpus_pipeline.near_stage(spark, frame(rows), data).collect()}
    assert got == slow_kept(rows) and 3 not in got


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [r.doc_id for r in near_dedup.drop_similar(docs).collect()]
    assert set(got) == slow_kept(rows) and len(got) == len(set(got))


def test_hard_rows_and_empty_table(frame):
    out = near_dedup.drop_similar(frame(HARD))
    assert out.columns == frame(HARD).columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 5, 6, 7]
    assert near_dedup.drop_similar(frame([])).collect() == []
