import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import HARD, LONG

from assay.llm import packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_cached_ids_equal_the_tokenizer(plain):
    rng = random.Random(5)
    pool = list("abcDEfÀéßñ́ΣσİŒçȺ ß  \x1c\x85\t\n'’\"!?.,;-_$&*#%|<>()0123456789²½漢字かなéАБв̈😀👍🏽‍") + ["'s", "'LL", "<|endoftext|>", "don't", "'ve", "ﬁ", "Ⅷ"]
    fast = tokens.WordTokens(PATH)
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(14)))
        assert np.frombuffer(fast.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def check(plain, rows, pieces):
    want = {}
    for doc, text, *_ in rows:
        want.setdefault(doc, []).append(plain.encode(text or "", add_special_tokens=False).ids + [1])
    by_sequence, covered = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
        covered.setdefault(p.doc_id, []).append(p)
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        at = 0
        for p in parts:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
    for doc, copies in want.items():
        assert sum(p.length for p in covered[doc]) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for p in sorted(covered[doc], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(copies[0])
                assert p.ids_crc32 == zlib.crc32(np.array(copies[0][at : at + p.length], "<u4").tobytes())
                at += p.length
    assert set(covered) == set(want)


def test_hard_rows(frame, plain):
    check(plain, HARD, packing.pack_documents(frame(HARD), PATH).collect())


def test_empty_table(frame):
    assert packing.pack_documents(frame([]), PATH).collect() == []


def test_many_tiny_and_some_long(frame, plain):
    rows = [(k, "a " * (k % 5)) for k in range(3000)] + [(9000 + k, LONG[: 700 * k]) for k in range(20)]
    out = packing.pack_documents(frame(rows), PATH).collect()
    check(plain, rows, out)
    per = {}
    for p in out:
        per[p.sequence_id] = per.get(p.sequence_id, 0) + 1
    assert max(per.values()) <= packing.MAX_SEGMENTS


def test_examples_keep_all_three_limits(spark):
    rng = random.Random(8)
    rows = [(k, rng.randrange(1, 900), 0) for k in range(800)]
    rows = [(k, t, rng.randrange(t + 1)) for k, t, _ in rows]
    df = spark.createDataFrame(rows, "id long, t long, l long").coalesce(1)
    out = packing.pack_examples(df, "id", "t", "l", max_tokens=2048, max_segments=6, max_loss=1024).collect()
    assert sorted(p.id for p in out) == list(range(800))
    by = {}
    for p in out:
        by.setdefault(p.sequence_id, []).append(rows[p.id])
    assert all(len(x) <= 6 and sum(r[1] for r in x) <= 2048 and sum(r[2] for r in x) <= 1024 for x in by.values())
    least = max(sum(r[1] for r in rows) / 2048, sum(r[2] for r in rows) / 1024, len(rows) / 6)
    assert len(by) <= 1.25 * least + 1


def test_examples_of_every_kind_come_back(spark):
    rows = [(1, 10, 5), (1, 10, 5), (2, 0, 0), (3, None, None), (None, 7, None), (4, 5000, 10), (5, 30, 99), (6, 2048, 20)]
    kind = "id long, t long, l long, start string, offset int, sequence_id string"
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], kind)
    out = packing.pack_examples(df, "id", "t", "l", max_loss=64).collect()
    placed = [p for p in out if p.sequence_id is not None]
    assert sorted((p.id or 0, p.length) for p in placed) == [(0, 7), (1, 10), (1, 10), (6, 2048)] and len(out) == len(rows)
    assert sorted((p.id, p.length, p.offset) for p in out if p.sequence_id is None) == [(2, 0, None), (3, 0, None), (4, 5000, None), (5, 30, None)]
    cut = packing.pack_examples(df, "id", "t", "l", max_loss=64, cut=True).collect()
    total = {}
    for p in cut:
        total[p.id] = total.get(p.id, 0) + p.length
    assert total == {1: 20, 2: 0, 3: 0, None: 7, 4: 5000, 5: 30, 6: 2048}
    assert packing.pack_examples(df.limit(0), "id", "t", "l").collect() == []
