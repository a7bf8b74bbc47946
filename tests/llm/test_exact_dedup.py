import hashlib
import random
import re

import pytest
from conftest_llm import HARD

from assay.llm import exact_dedup


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((r[0], low[norm(r[1])], len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows), key=str)


def run(df, **options):
    return exact_dedup.exact_groups(df, **options).collect()


def check(rows, out):
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == brute(rows)
    kept = [r.text_sha256 for r in out if r.kept]
    assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in out})
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_hard_rows(frame):
    check(HARD, run(frame(HARD)))


def test_empty_table(frame):
    assert run(frame([])) == []
    assert exact_dedup.drop_exact(frame([])).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force_with_small_digits(frame, seed):
    rng = random.Random(seed)
    rows = [(k, "".join(rng.choice("ab \n") for _ in range(rng.randrange(12)))) for k in range(300)]
    check(rows, run(frame(rows), first_digit=1, growth=2))


def test_hot_group_of_copies(frame):
    rows = [(k, "same text " * 50) for k in range(400)] + [(1000 + k, f"own {k}") for k in range(200)]
    check(rows, run(frame(rows)))


def test_drop_keeps_columns_and_one_row_a_text(frame):
    df = frame(HARD)
    out = exact_dedup.drop_exact(df)
    assert out.columns == df.columns
    texts = [re.sub(r"\s+", " ", r.text or "") for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({x[3] for x in brute(HARD)})


def test_matches_sql(spark, data, duck):
    from compare import same_rows

    from assay.llm.queries import ORACLES, QUERIES

    assert same_rows(QUERIES["op1_exact_dedup"](spark, data).toPandas(), duck.sql(ORACLES["op1_exact_dedup"]).df())
