import hashlib
import random
import re

import pytest
from conftest_llm import HARD

from assay.llm import pii


def brute(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.labelled_table())


def test_patterns_equal_definition():
    rng = random.Random(1)
    pool = list("0123456789") + list("a@.+- ()%-_.1@4\né٣")
    for _ in range(8000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(30)))
        assert pii.base_spans(text) == brute(text)


def test_long_runs_are_scanned_in_linear_time(field):
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "1 " * 100_000, "+1 " * 50_000, "a@" * 50_000):
        pii.spans_of([text], field)


def test_field_finds_held_out_values(field):
    rows = pii.labelled_table(repeats=3, seed=99)
    by = {}
    for s, token, label in rows:
        by.setdefault(s, []).append((token, label))
    right = total = 0
    for sentence in by.values():
        got = field.decode([field.scores([t for t, _ in sentence])])[0]
        right += sum(pii.LABELS[g] == label for g, (_, label) in zip(got, sentence))
        total += len(sentence)
    assert right / total > 0.98


def test_viterbi_equals_brute_force(field):
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 4):
        scores = rng.normal(size=(n, len(pii.LABELS)))
        best = max(itertools.product(range(len(pii.LABELS)), repeat=n), key=lambda p: sum(scores[k, x] for k, x in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:])))
        assert field.decode([scores, scores[:1]])[0].tolist() == list(best)


def test_added_spans(field):
    text = 'the token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" and ssn 123-45-6789 or phone (212) 555-1234 ok'
    base, more = pii.spans_of([text], field)[0]
    assert {(k, text[a:b]) for k, a, b in more} >= {("secret", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"), ("ssn", "123-45-6789")}
    assert "123-45-6789" not in pii.redacted(text, pii._joined(base + more))


def test_rows(frame):
    rows = [*HARD, (20, "mail a.b@c.example.com from 10.0.0.1 or +1 (212) 555-1234, card 4111 1111 1111 1111 😀 x@y.zz")]
    out = pii.find(frame(rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id == 20:
            base = brute(rows[-1][1])
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (2, 1, 1, 1)
            joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) <= set(r.spans.split(","))
        elif r.doc_id == 2:
            assert r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find(frame([])).collect() == []


def test_secrets_need_no_digits(field):
    rng, found, total = random.Random(3), {}, {}
    letters = lambda pool, n: "".join(rng.choice(pool) for _ in range(n))
    low = "abcdefghijklmnopqrstuvwxyz"
    makers = {
        "mixed": lambda: letters(low + low.upper() + "0123456789", 20),
        "akia": lambda: "AKIA" + letters(low.upper() + "234567", 16),
        "letters": lambda: letters(low + low.upper(), 24),
        "phrase": lambda: "".join(letters(low, rng.randrange(4, 8)).title() for _ in range(4)),
    }
    for kind, make in makers.items():
        for around in ('they found password="{}" in the file', 'an api token "{}" was leaked', "use key {} for the upload"):
            for _ in range(100):
                value = make()
                text = around.format(value)
                spans = {text[a:b] for k, a, b in pii.spans_of([text], field)[0][1] if k == "secret"}
                found[kind], total[kind] = found.get(kind, 0) + (value in spans), total.get(kind, 0) + 1
    assert all(found[k] >= 0.97 * total[k] for k in makers), found
    text = 'password="CorrectHorseBatteryStaple"'
    assert pii.spans_of([text], field)[0][1] == [("secret", 10, 35)]


def test_words_near_cues_are_no_secrets(field):
    for text in ("the secret of their extraordinary understanding was a key to internationalization", "the password is misunderstanding", "Wolfeschlegelsteinhausen and the INTERNATIONALISATION of law"):
        assert pii.spans_of([text], field)[0][1] == []


def test_tables_give_the_scores_of_the_features(field):
    import itertools

    import numpy as np

    rng, pool = random.Random(4), ["password", "key", "=", '"', "Abc", "abc", "1234", "a1b2", ".", "-", "AKIA" + "Q" * 16, "ssn", "Zebra" * 5, "7", "漢字", "😀"]
    sequences = [[rng.choice(pool) for _ in range(n)] for n in (1, 2, 3, 9, 40, 41, 200)]
    slow = field.decode([field.scores(t) for t in sequences])
    fast = field.labels([pii._reader(field).read(" ".join(t)) for t in sequences])
    move = lambda labels: sum(field.move[a, b] for a, b in itertools.pairwise(labels))
    for tokens, a, b in zip(sequences, slow, fast):
        scores = field.scores(tokens)
        total = [sum(scores[k, x] for k, x in enumerate(labels)) + move(labels) for labels in (a, b)]
        assert len(a) == len(b) == len(tokens) and np.isclose(*total)


def test_spans_of_values_put_into_documents(spark, field):
    """Recall by kind of values put into every document at a blank, under cue words or none; and what is added beside them."""
    rng = random.Random(6)
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect() if r.text and len(r.text) > 200]
    frames = {"secret": ('token = "{}"', "password={}", "api key {} was leaked", "auth bearer {}"), "ssn": ("ssn {}", "social security number : {}"), "phone": ("call {} now", "tel {}")}
    kinds = {"secret": ("secret", "key", "letters", "phrase"), "ssn": ("ssn",), "phone": ("local",)}
    found, total = {}, {}
    for k, text in enumerate(docs):
        label = ("secret", "ssn", "phone")[k % 3]
        value = pii._value(rng.choice(kinds[label]), rng)
        at = text.find(" ", rng.randrange(len(text) // 2))
        at = at if at > 0 else len(text)
        full = text[:at] + " " + rng.choice(frames[label]).format(value) + text[at:]
        base, more = pii.spans_of([full], field)[0]
        total[label] = total.get(label, 0) + 1
        found[label] = found.get(label, 0) + any(kind == label and full[a:b] == value for kind, a, b in more)
    assert all(found[x] >= 0.95 * total[x] for x in total), (found, total)


def test_clean_documents_get_no_further_spans(spark, field):
    """What is added in the documents as they are stands after a cue word."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = [(k, texts[n][max(0, a - 24) : a], texts[n][a:b]) for n, (_, more) in enumerate(pii.spans_of(texts, field)) for k, a, b in more]
    assert all(re.search(r"(?i)token|key|secret|password|ssn|phone|tel", before) or value.startswith("AKIA") for _, before, value in got), got


def test_a_long_text_of_digits_needs_little_memory():
    """5 MB of digits beside short texts, in a process of its own: under 1 GB."""
    import subprocess
    import sys

    code = (
        "import resource, time; from assay.llm import pii; f = pii.train(pii.labelled_table());"
        "texts = ['1 2 ' * 1_250_000] + ['call 555 now'] * 255; out = pii.spans_of(texts, f);"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024, len(out))"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    mb, n = map(int, done.stdout.split())
    assert n == 256 and mb < 1000, done
