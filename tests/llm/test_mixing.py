import numpy as np
from conftest_llm import HARD

from assay.llm import mixing


def rows_of(spark_rows):
    return [r.asDict() for r in spark_rows]


def check(out, most=3):
    by = {}
    for r in out:
        by.setdefault((r["source_size"], r["target"]), []).append(r)
        assert 0 <= r["taken"] <= most * r["size"]


def test_targets_fill_up():
    assert mixing.targets([10, 10, 10], [5, 2, 1]) == [18.75, 7.5, 3.75]
    assert mixing.targets([1, 100, 100], [5, 2, 1]) == [3.0, 132.0, 66.0]
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0]
    assert sum(mixing.targets([3, 50, 7, 1000], [5, 2, 1, 5])) == 1060


def test_tree_keeps_quotas():
    quotas = mixing.split_tree([100, 7, 0, 41], 16, 3)
    assert quotas.sum(0).tolist() == [100, 7, 0, 41]
    assert quotas.sum(1).max() - quotas.sum(1).min() <= 1
    assert (quotas == mixing.split_tree([100, 7, 0, 41], 16, 3)).all()


def test_counts_meet_targets_and_reruns_agree(frame):
    rng = np.random.default_rng(2)
    rows = [(k, "w " * int(rng.integers(0, 60)), ["b", "a", None, "ä", "hot", "hot", "hot"][k % 7]) for k in range(3000)] + [(9999, "w " * 9000, "b")]
    df = frame(rows)
    a = rows_of(mixing.mix_counts(df).collect())
    b = rows_of(mixing.mix_counts(df.repartition(7)).collect())
    key = lambda r: r["doc_id"]
    assert sorted(a, key=key) == sorted(b, key=key)
    sources = {r[0]: r[2] for r in rows}
    names = sorted({s for s in sources.values() if s is not None}) + [None]
    size = {s: sum(r["size"] for r in a if sources[r["doc_id"]] == s) for s in names}
    want = dict(zip(names, mixing.targets([size[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])))
    for s in names:
        own = [r for r in a if sources[r["doc_id"]] == s]
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 2
        assert all(r["target"] == want[s] and r["source_size"] == size[s] for r in own)
    check(a)


def test_hard_rows_and_empty_table(frame):
    out = rows_of(mixing.mix_counts(frame(HARD)).collect())
    assert len(out) == len(HARD)
    check(out)
    assert mixing.mix_counts(frame([])).collect() == []
    assert mixing.mix(frame([])).collect() == []


def test_mixed_rows_carry_the_counted_words(frame):
    rows = [(k, f"w{k} " * (1 + k % 13), "abc"[k % 3]) for k in range(700)]
    df = frame(rows)
    counts = {r.doc_id: r.taken for r in mixing.mix_counts(df).collect()}
    out = mixing.mix(df, shards=5)
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {k: v for k, v in counts.items() if v}


def table(frame, n=4000, sources="abcdefg", words=40):
    rng = np.random.default_rng(n)
    return frame([(k, "w " * int(rng.integers(0, words)), sources[int(rng.integers(len(sources)) ** 2 // len(sources))]) for k in range(n)])


def planned(docs, monkeypatch, rows=16, **options):
    from assay.llm.common import materialize

    monkeypatch.setattr(mixing, "BLOCK_ROWS", rows)
    narrow = materialize(docs.select(*mixing._facts(docs, "doc_id", "text", "source", mixing.SEED)))
    return narrow, mixing.plan(narrow, **options)


def test_draws_and_shards_against_brute_force(frame, monkeypatch):
    from pyspark.sql import functions as F

    narrow, (sources, draws, shards) = planned(table(frame), monkeypatch, shards=24)
    ties = ["sid", "block", "epoch"]
    known = {r.sid: r for r in sources.collect()}
    words = {(r.sid, r.block): r.words for r in mixing._with_block(narrow, sources).groupBy("sid", "block").agg(F.sum("size").alias("words")).collect()}
    wanted, sequence = {}, []
    for sid, s in known.items():
        own = sorted(b for k, b in words if k == sid and words[k, b] > 0)
        assert abs(sum(words[sid, b] for b in own) * s.epochs + s.rest - s.target) <= 0.5
        for epoch in range(s.epochs):
            wanted |= {(sid, b, epoch): words[sid, b] for b in own}
        left = s.rest
        frame_ = narrow.sparkSession.createDataFrame([(sid, b, s.epochs) for b in own], "sid long, block long, epochs int")
        for b in [r.block for r in frame_.orderBy(F.xxhash64(F.lit(mixing.SEED), F.lit("epoch"), "sid", "epochs", "block").bitwiseXOR(F.lit(-(1 << 63)).cast("long")), "block").collect()]:
            if left > 0:
                wanted[sid, b, s.epochs] = min(left, words[sid, b])
                left -= words[sid, b]
    got = draws.orderBy("sid", F.xxhash64(F.lit(mixing.SEED), F.lit("draw"), *ties).bitwiseXOR(F.lit(-(1 << 63)).cast("long")), *ties).collect()
    assert {(r.sid, r.block, r.epoch): r.taken for r in got} == wanted and len(got) == len(wanted)
    counts = [sum(r.sid == k for r in got) for k in sorted(known)]
    quotas = mixing.split_tree(counts, 24, mixing.SEED)
    for k in sorted(known):
        sequence = [r.shard for r in got if r.sid == k]
        assert sequence == np.repeat(np.arange(24), quotas[:, k]).tolist()


def test_subtrees_grown_apart_give_the_same_shards(frame, monkeypatch):
    docs = table(frame, 3000)
    whole = planned(docs, monkeypatch, shards=37)[1][1].collect()
    parts = planned(docs, monkeypatch, shards=37, top=4)[1][1].collect()
    assert sorted(whole) == sorted(parts)


def test_more_sources_than_groups(frame, monkeypatch):
    monkeypatch.setattr(mixing, "GROUPS", 3)
    _, (sources, draws, _) = planned(table(frame, 2000), monkeypatch, shards=8)
    got, per = draws.collect(), {}
    for r in got:
        per[r.shard] = per.get(r.shard, 0) + 1
    assert max(per.values()) - min(per.values()) <= 1 and len(per) == 8
    taken = {}
    for r in got:
        taken[r.sid] = taken.get(r.sid, 0) + r.taken
    assert all(abs(taken.get(s.sid, 0) - s.target) <= 0.5 for s in sources.collect())


def test_equal_rows_share_a_hot_key(frame):
    docs = frame([(None, "same words here", "a")] * 900 + [(k, "w " * 9, "b") for k in range(300)])
    out = mixing.mix_counts(docs).collect()
    want = {s: t for s, t in zip("ab", mixing.targets([2700, 2700], [5, 2]))}
    assert abs(sum(r.taken for r in out if r.doc_id is None) - want["a"]) <= 900 and len(out) == 1200


def test_the_shards_column_lists_the_draws(frame):
    docs = table(frame, 600)
    for r in mixing.mix_counts(docs, shards=5).collect():
        shards = [int(x) for x in r["shards"].split(",") if x]
        assert shards == sorted(shards) and all(0 <= x < 5 for x in shards) and (len(shards) > 0) == (r.taken > 0) and len(shards) <= 4
