import random

import numpy as np
import xxhash
from conftest_llm import HARD

from assay.llm import components, simhash


def slow_print(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(points):
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    points = sorted(points)
    for i, a in enumerate(points):
        for b in points[:i]:
            if bin(a ^ b).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in points}


def clustered(rng, n, centers, flips):
    out = set()
    base = [rng.getrandbits(64) for _ in range(centers)]
    while len(out) < n:
        p = rng.choice(base)
        for b in rng.sample(range(64), rng.randrange(flips + 1)):
            p ^= 1 << b
        out.add(p)
    return out


def merged(points, edges):
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {p: find(p) for p in points}


def test_print_equals_definition():
    rng = random.Random(3)
    for text in ["", "a", "a b", "A b\tC", "x y z " * 40, " ".join(rng.choice("abcdef") for _ in range(500)), "é É ß"]:
        assert simhash.fingerprint(text) == slow_print(text)


def test_links_of_random_and_clustered_points():
    rng = random.Random(4)
    for centers, flips in ((400, 3), (3, 4), (1, 5)):
        points = clustered(rng, 700, centers, flips)
        edges = simhash.links(np.array(sorted(points), np.uint64), leaf=32).tolist()
        assert merged(points, edges) == slow_components(points)


def test_midpoints_equal_pairs():
    rng = random.Random(5)
    points = np.array(sorted(clustered(rng, 400, 2, 4)), np.uint64)
    a = merged(points.tolist(), np.stack(simhash._by_midpoints(points), 1).tolist())
    b = merged(points.tolist(), np.stack(simhash._by_pairs(points, 2), 1).tolist())
    assert a == b


def test_shards_of_the_tree_lose_no_link(spark):
    rng = random.Random(6)
    points = clustered(rng, 900, 60, 4)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in points]
    prints = spark.createDataFrame(signed, "fp long")
    out = simhash.near_components(prints, sample=500, shard=64).collect()
    got = {p: p for p in points} | {r.vertex & (2**64 - 1): r.root & (2**64 - 1) for r in out}
    want = slow_components(points)
    classes = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert classes(got) == classes(want)


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(1000, 1000 + k) for k in range(1, 60)] + [(-5, -6)]
    out = {r.vertex: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(out[k] == 0 for k in range(41)) and all(out[1000 + k] == 1000 for k in range(60)) and out[-5] == out[-6] == -6
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hard_rows_and_empty_table(frame):
    out = simhash.near_groups(frame(HARD)).collect()
    assert len(out) == len(HARD)
    prints = {}
    for doc, text, *_ in HARD:
        prints.setdefault(slow_print(text), []).append(doc)
    comps = slow_components(prints)
    members = {}
    for p, r in comps.items():
        members.setdefault(r, []).extend(x for x in prints[p] if x is not None)
    want = sorted(((d, f"{slow_print(t):016x}", min(members[comps[slow_print(t)]], default=None)) for d, t, *_ in HARD), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in out), key=str) == want
    assert simhash.near_groups(frame([])).collect() == []
    kept = simhash.drop_near(frame(HARD))
    assert kept.columns == frame(HARD).columns and kept.count() == len(set(comps.values()))


def test_query_against_brute_force(spark, data):
    from assay.llm.queries import QUERIES

    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    prints = {}
    for r in rows:
        prints.setdefault(slow_print(r.text), []).append(r.doc_id)
    comps = slow_components(prints)
    low = {}
    for p, r in comps.items():
        low[r] = min([low.get(r, 1 << 62), *prints[p]])
    want = {r.doc_id: low[comps[slow_print(r.text)]] for r in rows}
    assert {r.doc_id: r.component_id for r in QUERIES["op5_simhash"](spark, data).collect()} == want


def test_midpoints_in_several_passes():
    rng = np.random.default_rng(9)
    points = np.unique(np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, 3000, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000, np.uint64)))
    one = set(zip(*(x.tolist() for x in simhash._by_midpoints(points))))
    for most in (1 << 12, 1 << 16):
        assert set(zip(*(x.tolist() for x in simhash._by_midpoints(points, most)))) == one
