import zlib

import numpy as np
import pytest
from conftest_llm import HARD, LONG

from assay.llm import langid, quality, subwords, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def held(rows, labels, truth, folds, which):
    want = {r.doc_id: r[truth] for r in labels}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == which) for r in rows)
    return [(want[r.doc_id], r) for r in rows if r.held_out and r.doc_id in want]


def auc(truth, scores):
    """The probability that a random one of label 1 scores above a random one of label 0; ties count half."""
    truth, scores = np.array(truth, bool), np.array(scores)
    _, group, size = np.unique(scores, return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - (size - 1) / 2)[group]
    n = truth.sum()
    return (rank[truth].sum() - n * (n + 1) / 2) / (n * (len(truth) - n))


def recall_precision(pairs):
    hit = sum(y == 1 and r.predicted == 1 for y, r in pairs)
    return hit / sum(y == 1 for y, _ in pairs), hit / sum(r.predicted == 1 for _, r in pairs)


LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def large(spark):
    return spark.read.parquet(f"{LARGE}/documents.parquet"), spark.read.parquet(f"{LARGE}/labels.parquet")


def test_quality_on_the_held_out_fold(large):
    """Against the base rate of 0.86: the rarer class, bad documents, must be found, not the common one guessed."""
    rows = quality.score_documents(*large).collect()
    assert len(rows) == large[0].count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    pairs = held(rows, large[1].collect(), "quality", 4, 2)
    assert auc([y for y, _ in pairs], [r.score for _, r in pairs]) > 0.97
    bad = [(y, r) for y, r in pairs if y == 0]
    assert 0.05 < len(bad) / len(pairs) < 0.25 and np.mean([r.predicted == 0 for _, r in bad]) > 0.9
    assert np.mean([r.predicted == 1 for y, r in pairs if y == 1]) > 0.97


def test_language_on_the_held_out_fold(docs):
    rows = langid.identify(docs).collect()
    pairs = held(rows, docs.select("doc_id", "lang").collect(), "lang", 4, 2)
    assert np.mean([y == r.lang_pred for y, r in pairs]) > 0.98


def test_toxicity_on_the_held_out_fold(large):
    """Against a base rate of 0.12, at which a constant finds nothing."""
    rows = toxicity.score_documents(*large).collect()
    pairs = held(rows, large[1].collect(), "toxic", 5, 0)
    recall, precision = recall_precision(pairs)
    assert recall > 0.9 and precision > 0.9 and auc([y for y, _ in pairs], [r.score for _, r in pairs]) > 0.94


def test_scores_against_a_plain_python_model(docs, labels, spark):
    """The quality and language queries over all rows, against features counted one by one in plain Python."""
    from collections import Counter

    mix, base, mask = 0x9E3779B97F4A7C15, 1099511628211, (1 << 64) - 1

    def plain(scorer, text, temperature=1.0):
        f, raw = scorer.features, text.encode("utf-8", "replace")
        raw = raw.lower() if f.lower else raw
        found = Counter()
        for n in f.orders:
            for k in range(len(raw)):
                gram = int.from_bytes(raw[k : k + n], "little")
                found[((gram + n) * mix & mask) >> (64 - f.bits)] += 1
        last = None
        for word in bytes(b if b > 32 else 32 for b in raw).split():
            h = sum(b * pow(base, k, 1 << 64) for k, b in enumerate(word)) & mask ^ len(word)
            found[(h * mix & mask) >> (64 - f.bits)] += 1
            found[(1 << f.bits) - 1] += h == last
            last = h
        z = np.array([sum(float(row[k]) * n for k, n in found.items()) for row in scorer.table]) / max(1, sum(found.values())) + scorer.bias
        e = np.exp((z - z.max()) / temperature)
        return e / e.sum()

    model = quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.orderBy(docs.doc_id).limit(1000).collect()}
    some = [k for k in texts if len(texts[k] or "") < 1500][:120]
    got = {r.doc_id: r for r in quality.score_documents(docs, labels).collect()}
    assert all(abs(got[k].score - plain(model, texts[k] or "")[1]) < 1e-4 for k in some)
    lang = langid.fit(langid.sample(docs, None, "lang", langid.FOLDS, langid.HELD_OUT, langid.TRAIN_ROWS))
    told = {r.doc_id: r for r in langid.identify(docs).collect()}
    for k in some:
        if texts[k]:
            p = plain(lang.scorer, texts[k], lang.temperature)
            assert told[k].lang_pred == lang.names[p.argmax()] and abs(told[k].score - p.max()) < 1e-4


def test_toxicity_query_against_plain_steps(docs, labels):
    """The query over all rows, against the model applied text by text, without any of its memories."""
    pairs = [(t, int(y)) for t, y in toxicity.sample(docs, labels, "toxic", toxicity.FOLDS, toxicity.HELD_OUT, toxicity.TRAIN_ROWS)]
    model = toxicity.fit(pairs)
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    for r in docs.collect():
        words = toxicity.restore(r.text or "", model.chars) | {w for run in toxicity.scraps((r.text or "").lower().split()) if (w := toxicity.decode(" ".join(run), model.chars)) in model.words and toxicity._letters("".join(run)) in model.words}
        marks = dict(model.marks(list(words)))
        z = model.logistic[0] + model.logistic[1] * max(marks.values(), default=0.0) + model.logistic[2] * np.log1p(len(marks))
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9, r.doc_id


@pytest.fixture(scope="module")
def trained(large):
    return toxicity.fit([(t, int(y)) for t, y in toxicity.sample(*large, "toxic", toxicity.FOLDS, toxicity.HELD_OUT, toxicity.TRAIN_ROWS)])


@pytest.mark.parametrize("text", ["you are an id iot my friend", "what a st up id thing", "such a tr ash talk", "tr4 sh", "an\ni\nd\ni\no\nt", "idiiot", "!diot"])
def test_hidden_words_score(trained, text):
    assert trained.score(text) > 0.5 > trained.score("it is an old hat on the mat of the day")


def test_language_is_rejected_where_it_is_none_of_the_known(docs, frame):
    """Foreign scripts are marked as rejected; hardly any known text is."""
    foreign = ["שלום עולם זה טקסט בעברית", "这是一个中文文本 没有别的", "это русский текст о погоде", "αυτό είναι ένα κείμενο", "これは日本語の文章です"]
    known = docs.select("doc_id", "text", "lang").filter("lang is not null and length(text) > 100")
    mixed = known.unionByName(frame([(10**6 + k, t * 20) for k, t in enumerate(foreign)]).selectExpr("doc_id", "text", "cast(null as string) as lang"))
    rows = langid.identify(mixed).collect()
    assert np.mean([r.rejected for r in rows if r.doc_id < 10**6]) < 0.02
    assert sum(r.rejected for r in rows if r.doc_id >= 10**6) >= 4, [(r.lang_pred, r.score) for r in rows if r.doc_id >= 10**6]


def test_hidden_words_are_restored():
    from collections import Counter

    chars = toxicity.CharModel(Counter({"idiot": 50, "moron": 50, "scum": 50, "worthless": 50, "loser": 50, "the": 900, "of": 500, "and": 700, "a": 300, "you": 100, "are": 100}))
    for shown, word in [("1d10t", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiooot", "idiot"), ("m0r0n", "moron"), ("5cum", "scum"), ("w-o-r-t-h-l-e-s-s", "worthless"), ("you are a l o s e r", "loser"), ("IDIOT!!!", "idiot")]:
        assert word in toxicity.restore(shown, chars), shown
    assert toxicity.restore("", chars) == set() and toxicity.restore("the the", chars) == {"the"}


def test_viterbi_takes_the_cheapest_path():
    import itertools
    from collections import Counter

    chars = toxicity.CharModel(Counter({"abba": 5, "bab": 3, "cab": 2}))
    for span in ("a8b4", "c4b", "aab", "a-b"):
        ways = toxicity.lattice(span)
        scored = []
        for path in itertools.product(*ways):
            past, total = "  ", 0.0
            for c, price in path:
                total += price
                if c and not (c == " " and past[1] == " "):
                    total += chars.cost(past, c)
                    past = "  " if c == " " else past[1] + c
            total += chars.cost(past, " ") if past[1] != " " else 0.0
            scored.append((total, "".join(c for c, _ in path).strip()))
        assert toxicity.decode(span, chars) == max(scored)[1]


def test_long_spans_and_texts():
    from collections import Counter

    model = toxicity.fit([("you idiot", 1), ("the sun", 0)] * 20)
    assert 0 <= model.score("1d10t" * 2000) <= 1 and 0 <= model.score("x " * 20_000) <= 1 and 0 <= model.score("a" * 100_000) <= 1
    assert isinstance(toxicity.CharModel(Counter()), toxicity.CharModel)


def test_features_do_not_depend_on_the_batch():
    f = subwords.Features()
    texts = [b"alpha beta beta", b"", b"x", "gräßlich".encode()]
    together, owner = f(texts)
    for k, t in enumerate(texts):
        alone, _ = f([t])
        assert sorted(together[owner == k].tolist()) == sorted(alone.tolist())


def test_scores_do_not_depend_on_the_batch():
    model = subwords.train(["good words here", "#### $$$ !!!"] * 5, np.array([1, 0] * 5), 2, subwords.Features(bits=12), epochs=3)
    texts = ["good words", "", LONG, "$$$ ###", "é" * 2_000_000]
    together = model.probabilities(texts)
    for k, t in enumerate(texts):
        assert np.allclose(model.probabilities([t])[0], together[k])


def test_long_texts_are_read_in_blocks_without_a_seam(monkeypatch):
    rng = np.random.default_rng(3)
    words = ["alpha", "be", "x" * 700, "gräßlich", "beta"]
    text = " ".join(words[int(k)] + "\n" * int(k == 1) for k in rng.integers(0, 5, 600)) + "y" * 3000 + " z  z"
    f = subwords.Features(bits=14)
    whole, _ = f([text.encode()])
    for part in (64, 257, 1000, 1 << 18):
        monkeypatch.setattr(subwords, "PART", part)
        assert sorted(np.concatenate(list(f.blocks(text.encode()))).tolist()) == sorted(whole.tolist())
    assert list(f.blocks(b"")) == []


@pytest.mark.parametrize("run", ["quality", "lang", "toxic"])
def test_hard_rows_and_empty_tables(spark, frame, run):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (7, None, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.filter("1 = 0")
    go = {"quality": lambda d, x: quality.score_documents(d, x), "lang": lambda d, x: langid.identify(d), "toxic": lambda d, x: toxicity.score_documents(d, x)}[run]
    for given in (labels, none):
        rows = go(frame(HARD), given).collect()
        assert len(rows) == len(HARD) and all(0 <= r.score <= 1 for r in rows)
    assert go(frame([]), labels).collect() == []
    if run == "lang":
        by = {(r.doc_id, r.lang_pred) for r in rows}
        assert (2, "und") in by and (3, "und") in by and (5, "en") in by
    if run == "quality":
        assert quality.keep_good(frame(HARD), labels).columns == frame(HARD).columns


def test_only_letters_count_as_letters():
    model = langid.Model(["en"], subwords.train(["a"], np.array([0]), 1, subwords.Features(bits=8), epochs=1))
    assert model.predict(["²", "_1", "x", None, "漢"]).lang_pred.tolist() == ["und", "und", "en", "und", "en"]
