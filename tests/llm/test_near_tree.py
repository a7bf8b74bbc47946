"""The near-dedup stage makes the SimHash search; what it brings together is checked, not believed."""

import random

from assay.llm import near_dedup
from assay.llm.common import materialize


def linked(spark, rows):
    """The groups of (text, SimHash or None for its own) that come together without any MinHash bucket."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = [(signed(near_dedup.sketch(t)[0]), near_dedup.sketch(t)[1], signed(near_dedup.sketch(t)[2] if sim is None else sim), [], k, t) for k, (t, sim) in enumerate(rows)]
    all_ = materialize(spark.createDataFrame(found, "fp long, n long, sim long, bands array<long>, rid long, text string"))
    out = near_dedup.similar_components(all_.select("fp", "n", "sim", "bands"), all_.select("fp", "rid"), all_.select("rid", "text")).collect()
    at, groups = {r[0]: r[4] for r in found}, {}
    for r in out:
        groups.setdefault(r.root, set()).add(at[r.vertex])
    return sorted(sorted(g) for g in groups.values())


def test_the_tree_finds_close_texts_and_unlike_ones_stay_apart(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    rows = []
    for _ in range(6):
        plain = [word() for _ in range(2000)]
        rows += [(" ".join(plain), None), (" ".join([*plain[:-1], word()]), None)]  # one shingle in 2000
    for _ in range(3):
        rows.append((" ".join(word() for _ in range(300)), 12345))  # one SimHash, nothing in common
    assert linked(spark, rows) == [[2 * k, 2 * k + 1] for k in range(6)]


def test_a_fingerprint_is_the_majority_of_the_set():
    import xxhash

    text = "one two three four five six seven one two three four five six seven"
    hashes = [xxhash.xxh64_intdigest(s, near_dedup.SEED) for s in near_dedup.shingles(text)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert near_dedup.sketch(text)[2] == want
