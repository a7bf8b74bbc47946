import re
import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from assay.llm import mixing


def test_stages_against_brute_force(spark, tmp_path):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "_"))
        stage(spark, frames[-1], data).write.parquet(path)
        frames.append(spark.read.parquet(path))
    first, good, exact, near, mixed, packed = ([r.asDict() for r in f.collect()] for f in frames)
    assert all(f.columns == columns for f in frames[:-1])
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    assert np.mean([(y == 1) == (d in kept) for d, y in truth.items()]) > 0.95

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    low = {}
    for r in good:
        low[norm(r["text"])] = min(low.get(norm(r["text"]), 1 << 62), r["doc_id"])
    assert {r["doc_id"] for r in exact} == set(low.values()) and len(exact) == len(low)

    from test_near_dedup import slow_kept

    stay = slow_kept([(r["doc_id"], r["text"]) for r in exact])
    assert {r["doc_id"] for r in near} == stay and len(near) == len(stay) < len(exact)

    words = lambda t: len((t or "").encode().split())
    size, taken = {}, {}
    for r in near:
        size[r["source"]] = size.get(r["source"], 0) + words(r["text"])
    for r in mixed:
        taken[r["source"]] = taken.get(r["source"], 0) + words(r["text"])
    names = sorted(size)
    for s, t in zip(names, mixing.targets([size[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])):
        assert abs(taken.get(s, 0) - t) <= 2

    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = {}
    for p in packed:
        total[p["doc_id"]] = total.get(p["doc_id"], 0) + p["length"]
    want, texts = {}, {}
    for r in mixed:
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + len(ids)
        texts.setdefault(r["doc_id"], []).append(ids)
    assert total == want
    for p in packed[:500]:
        assert any(zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] for ids in texts[p["doc_id"]])
    lengths = {}
    for p in packed:
        lengths[p["sequence_id"]] = lengths.get(p["sequence_id"], 0) + p["length"]
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths.values())


def test_run_gives_what_the_stages_give(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_stages_take_hard_rows_and_empty_tables(spark, frame, data, tmp_path):
    from conftest_llm import HARD

    for name, rows in (("hard", HARD), ("empty", [])):
        docs = frame(rows)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}{k}")
            stage(spark, docs, data).write.parquet(path)
            after = spark.read.parquet(path)
            assert k == 4 or after.columns == docs.columns
            docs = after
        assert (docs.count() > 0) == bool(rows)


def test_each_stage_takes_hard_rows_by_itself(spark, frame, data):
    from conftest_llm import HARD

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(HARD), data).count() > 0


def test_stages_compose_without_writing_in_between(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    assert docs.count() == corpus_pipeline.run(spark, data).count() > 0


def test_two_pipelines_at_once(spark, data):
    from concurrent.futures import ThreadPoolExecutor

    rows = lambda _: sorted(map(tuple, corpus_pipeline.run(spark, data).select("doc_id", "start", "length", "ids_crc32").collect()), key=repr)
    with ThreadPoolExecutor(2) as pool:
        a, b = pool.map(rows, range(2))
    total = lambda got: sum(r[2] for r in got)
    assert total(a) == total(b) > 0


def test_a_run_leaves_only_what_its_result_reads(spark, data, tmp_path):
    import os
    import urllib.parse

    from assay.operators.scratch import folder

    base = os.path.dirname(urllib.parse.urlparse(folder(spark)).path)
    before = set(os.listdir(base)) if os.path.exists(base) else set()
    out = corpus_pipeline.run(spark, data)
    left = set(os.listdir(base)) - before
    read = {f.split("/assay/")[1].split("/")[0] for f in out.inputFiles()}
    assert left == read


def test_training_leaves_no_memory_behind(spark, data, monkeypatch):
    """The quality stage gives what its training has taken back to the system; the texts are dropped before."""
    from assay.llm import quality

    held, back = [], []
    monkeypatch.setattr(quality, "give_back", lambda: back.append(sum(1 for w in held if w() is not None)))

    class Pairs(list):
        pass

    def seen(*a, **k):
        import weakref

        found = Pairs(sample(*a, **k))
        held.append(weakref.ref(found))
        return found

    sample = quality.sample
    monkeypatch.setattr(quality, "sample", seen)
    assert quality.keep_good(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")).count() > 0
    assert back == [0]
