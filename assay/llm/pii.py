"""Personal data in texts: exact patterns, and a linear-chain conditional random field for what patterns miss.

The patterns give email, ip, card and phone spans. The random field labels every token (runs of letters and digits, single signs)
of the whole text from word-shape features of the token and its neighbours and a few cue words before it. It is trained by maximum likelihood
from a small labelled table (``labelled_table``, or one given) and decoded by Viterbi over numpy batches of texts. Its
phone, secret and ssn spans that touch no pattern's span are added; pattern spans always stay.

A token's shape and cue are looked up once a worker; feature weights are folded into tables by pairs of neighbouring shapes, so that a text's
scores are four lookups a token. Batches are bounded by cells (texts times the longest), the scores of a batch are made a block
of steps at a time, and a long text is a batch of its own that holds its back-pointers alone, 7 bytes a token.

All positions are code points, ends exclusive. Every scan is linear in the text, also for very long runs without blanks. Null and empty
texts have no spans (empty strings, zero counts). Null and repeated doc_ids and repeated rows each get their own row; ties between labels go
to the first. An empty table gives an empty result. Only id and text are read, so extra columns never clash.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

KINDS = ("email", "ip", "card", "phone", "secret", "ssn")
ADDED = ("phone", "secret", "ssn")
LABELS = ("O", *KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
#: Steps times texts of a batch whose labels, and of a block whose scores, are held at once.
CELLS, BLOCK = 1 << 20, 1 << 18
#: Tokens that a worker remembers, of up to so many characters, before it starts afresh; changes no result.
CACHED, SHORT = 200_000, 48
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans: (kind, start, end), by kind as listed, then start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not _DIGITS.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


# ---------------------------------------------------------------- features

_CUES = frozenset("token key secret password passwd pwd api auth bearer ssn social security phone tel call mobile fax ip host server card visa version page year".split())


def _length(n: int) -> str:
    return str(n) if n <= 4 else "5-8" if n <= 8 else "9-15" if n <= 15 else "16-19" if n <= 19 else "20+"


def shape(token: str) -> str:
    """What kind of word a token is: a sign itself, or letters and digits by case and mixture, with its length class."""
    if not token[0].isalnum():
        return token
    if len(token) == 20 and token.startswith("AKIA"):
        return "AKIA"
    if token.isdigit():
        return "d" + _length(len(token))
    if any(map(str.isdigit, token)):
        low = token.lower() == token
        hex_ = "h" if all(c in "0123456789abcdefABCDEF" for c in token) else "m"
        return hex_ + ("l" if low else "u" if token.upper() == token else "c") + _length(len(token))
    case = "l" if token.islower() else "u" if token.isupper() else "t" if token[1:].islower() else "c"
    return "w" + case + ("" if len(token) < 12 else "~" if len(token) < 16 else "+" if len(token) < 20 else "++")


def features(tokens: list[str]) -> list[list[str]]:
    """The feature names of each token of a sequence."""
    shapes = [shape(t) for t in tokens]
    cues = [t.lower() if t.lower() in _CUES else "" for t in tokens]
    out = []
    for k in range(len(tokens)):
        at = lambda j: shapes[k + j] if 0 <= k + j < len(tokens) else "#"  # noqa: B023, E731
        near = {c for c in cues[max(0, k - 4) : k] if c}
        out.append(["0" + at(0), "-" + at(-1), "+" + at(1), "=" + at(-1) + "|" + at(0), "~" + at(0) + "|" + at(1), "<" + at(-2) + "|" + at(-1), ">" + at(1) + "|" + at(2), *("c" + c for c in near)])
    return out


# ---------------------------------------------------------------- the labelled table

#: Sentence patterns; {kind} stands for a value whose tokens carry that label. Words between them are outside.
SENTENCES = (
    "please call {phone} before noon .",
    "phone : {phone} , ask for the desk",
    "tel {phone} or mail {email} today",
    "reach me at {email} or {phone} .",
    "my mobile is {phone}",
    "api key = \"{secret}\" was leaked",
    "token = \"{secret}\"",
    "password={secret} in the file",
    "secret : {secret} ;",
    "use {key} for the upload",
    "password=\"{key}\" in the file",
    "an api token \"{key}\" was found",
    "with key {key} for it",
    "password=\"{phrase}\" in it",
    "an api token \"{phrase}\" was lost",
    "key {phrase} for all",
    "take key {phrase} to open it",
    "by key {phrase} or key {letters}",
    "the key {key} expired in {year} .",
    "auth bearer {secret} was sent",
    "ssn {ssn} on the form",
    "social security number : {ssn} .",
    "his number {ssn} was shown",
    "server {ip} did not answer",
    "from {ip} to {ip} in {small} ms",
    "paid with card {card} on monday",
    "{card} was declined , see page {small}",
    "write to {email} , version {small} . {small}",
    "in {year} there were {number} cases and {small} more",
    "it cost $ {small} . {two} at {small} : {two} on {small} / {small} / {year}",
    "chapter {small} , page {number} of {number}",
    "version {small} . {small} . {small} of the work",
    "the word thsh {word} and then {number} of it",
    "( {small} ) the first item , ( {small} ) the second",
    "a total of {number} - {number} units , {small} % up",
    "call {local} after {small} pm",
    "phone {local} or {phone}",
    "item {mixed} is in stock , order {number}",
    "about {small} - {two} - {year} they left",
    "password=\"{phrase}\" was set",
    "passwd = {phrase}",
    "pwd : \"{phrase}\" ;",
    "secret={phrase} in the file",
    "with key {phrase} you log in",
    "api token \"{letters}\" was leaked",
    "the key {letters} expired",
    "bearer {letters} was sent",
    "use {letters} for the upload",
    "the secret of {long} lies in {long} and {long} alone",
    "a key word , {long} , the key to {long} .",
    "password policy and {long} , token by token",
    "a new password is {long} ; the api of {long}",
    "the auth page : {long} {long}",
    "{name} and {name} wrote to {name}",
    "{loud} AND {loud} : {long}",
    "class {camel} calls {camel} , see {camel}",
)


def _value(kind: str, rng: random.Random) -> str:
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    low = "abcdefghijklmnopqrstuvwxyz"
    if kind == "phone":
        return rng.choice((f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}", f"+{digits(11)}"))
    if kind == "local":
        return rng.choice((f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"))
    if kind == "email":
        return f"{letters(low, 6)}.{digits(2)}@{letters(low, 5)}{digits(1)}.example.com"
    if kind == "secret":
        return rng.choice((letters("0123456789abcdef", rng.choice((18, 32, 40))), letters(low + low.upper() + "0123456789", rng.choice((20, 24, 36)))))
    if kind == "key":
        return "AKIA" + letters("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)
    if kind == "letters":
        return letters(low + low.upper(), rng.choice((20, 24, 36)))
    if kind == "phrase":
        words = [letters(low, rng.randrange(4, 8)) for _ in range(4)]
        return "".join(w.title() for w in words) if rng.random() < 0.7 else "".join(words)
    if kind in ("long", "name", "loud"):
        word = letters(low, rng.randrange(6, 20))
        return word if kind == "long" else word.title() if kind == "name" else word.upper()
    if kind == "camel":
        return "".join(letters(low, rng.randrange(3, 7)).title() for _ in range(rng.randrange(2, 5)))
    if kind == "ssn":
        return f"{digits(3)}-{digits(2)}-{digits(4)}"
    if kind == "ip":
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == "card":
        return rng.choice((digits(16), f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}"))
    return {"small": str(rng.randrange(1, 60)), "two": digits(2), "year": f"{rng.choice((19, 20))}{digits(2)}", "number": str(rng.randrange(100, 99999)), "word": letters(low, 7), "mixed": letters(low, 2).upper() + digits(3)}[kind]


def _plain(rng: random.Random) -> str:
    """Some plain words of all lengths and cases and common signs, as text stands around a value."""
    out = []
    for _ in range(rng.randrange(7)):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(min(26, 1 + int(rng.expovariate(0.2)))))
        out.append(rng.choice((word, word, word, word.title(), word.upper(), word + rng.choice(".,;:!?"), f'"{word}"', f"({word})", f"{word}-{word[:4]}", f"{word}'s", str(rng.randrange(3000)))))
    return " ".join(out)


def labelled_table(repeats: int = 12, seed: int = 11) -> list[tuple[int, str, str]]:
    """A small table of (sentence, token, label), made from the sentence patterns among plain words."""
    rng, rows, number = random.Random(seed), [], 0
    as_label = {"local": "phone", "key": "secret", "letters": "secret", "phrase": "secret"}
    for _ in range(repeats):
        for pattern in (*SENTENCES, "", "", "", ""):
            if rng.random() < 0.7:
                pattern = f"{_plain(rng)} {pattern} {_plain(rng)}"
            for part in re.split(r"(\{\w+\})", pattern):
                kind = part[1:-1] if part.startswith("{") else ""
                label = as_label.get(kind, kind) if as_label.get(kind, kind) in LABELS else "O"
                rows += [(number, t, label) for t in _TOKEN.findall(_value(kind, rng) if kind else part)]
            number += 1
    return rows


# ---------------------------------------------------------------- the random field


class Field:
    """Weights of a linear-chain conditional random field, by feature name and folded by shape: row 0 of a table is any
    shape that training has not met, row 1 the text's edge."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move
        known = sorted({n[1:] for n in names if n[0] == "0"})
        self.shapes = {"#": 1} | {x: k + 2 for k, x in enumerate(known)}
        self.cues = {c: k + 1 for k, c in enumerate(sorted(_CUES))}
        none = np.zeros(len(LABELS))
        weight = lambda f: emit[names[f]] if f in names else none
        n = len(self.shapes) + 1
        self.here, self.next, self.before, self.after = (np.zeros((n, n, len(LABELS))) for _ in range(4))
        for x, i in self.shapes.items():
            self.here[:, i] += weight("0" + x)
            self.here[i] += weight("-" + x)
            self.next[:, i] += weight("+" + x)
            for y, j in self.shapes.items():
                self.here[i, j] += weight(f"={x}|{y}")
                self.next[i, j] += weight(f"~{x}|{y}")
                self.before[i, j] = weight(f"<{x}|{y}")
                self.after[i, j] = weight(f">{x}|{y}")
        self.cue = np.array([none] + [weight("c" + c) for c in self.cues])

    def scores(self, tokens: list[str]) -> np.ndarray:
        """Each token's scores by label, feature by feature; what ``labels`` reads from the tables."""
        out = np.zeros((len(tokens), self.move.shape[0]))
        for k, row in enumerate(features(tokens)):
            for f in row:
                i = self.names.get(f)
                if i is not None:
                    out[k] += self.emit[i]
        return out

    def decode(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each sequence of token scores."""

        def scored(rows: list[int], longest: int) -> Callable[[int, int], np.ndarray]:
            padded = np.zeros((len(rows), longest, self.move.shape[0]))
            for r, k in enumerate(rows):
                padded[r, : len(sequences[k])] = sequences[k]
            return lambda a, b: padded[:, a:b]

        return self._batched([len(x) for x in sequences], scored)

    def labels(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each sequence of tokens, each given as 64 times its shape's number plus its cue's."""

        def scored(rows: list[int], longest: int) -> Callable[[int, int], np.ndarray]:
            shape = np.ones((len(rows), longest + 4), np.int32)
            owner, at, cue = [], [], []
            for r, k in enumerate(rows):
                shape[r, 2 : 2 + len(sequences[k])] = sequences[k] >> 6
                for t in np.flatnonzero(sequences[k] & 63).tolist():
                    owner += [r] * 4
                    at += range(t + 1, t + 5)
                    cue += [int(sequences[k][t] & 63)] * 4
            near = np.unique(np.array([at, owner, cue], np.int64).reshape(3, -1), axis=1)

            def part(a: int, b: int) -> np.ndarray:
                w = [shape[:, a + d : b + d] for d in range(5)]  # from two before to two after
                out = self.here[w[1], w[2]] + self.next[w[2], w[3]] + self.before[w[0], w[1]] + self.after[w[3], w[4]]
                lo, hi = np.searchsorted(near[0], (a, b))
                np.add.at(out, (near[1, lo:hi], near[0, lo:hi] - a), self.cue[near[2, lo:hi]])
                return out

            return part

        return self._batched([len(x) for x in sequences], scored)

    def _batched(self, lengths: list[int], scored: Callable) -> list[np.ndarray]:
        out = [np.zeros(0, np.int8)] * len(lengths)
        order = sorted((k for k, n in enumerate(lengths) if n), key=lambda k: -lengths[k])
        while order:
            longest = lengths[order[0]]
            rows, order = order[: max(1, CELLS // longest)], order[max(1, CELLS // longest) :]
            paths = self._viterbi(np.array([lengths[k] for k in rows]), scored(rows, longest))
            for r, k in enumerate(rows):
                out[k] = paths[: lengths[k], r].copy()
        return out

    def _viterbi(self, lengths: np.ndarray, scored: Callable[[int, int], np.ndarray]) -> np.ndarray:
        """The best labels, (step, sequence), of sequences from the longest to the shortest; ``scored(a, b)`` has steps a to b."""
        n, longest = len(lengths), int(lengths[0])
        live = np.searchsorted(-lengths, -np.arange(longest), "left")  # sequences longer than t
        back, block = np.zeros((longest, n, self.move.shape[0]), np.int8), max(1, BLOCK // n)
        to, every = np.ascontiguousarray(self.move.T)[None], np.arange(n)
        best = None
        for a in range(0, longest, block):
            part = scored(a, min(longest, a + block))
            for t in range(a, min(longest, a + block)):
                if best is None:
                    best = part[:, 0].copy()
                    continue
                m = live[t]
                ways = best[:m, None, :] + to
                ways.argmax(2, out=(step := np.empty((m, len(LABELS)), np.int64)))
                back[t, :m] = step
                best[:m] = np.take_along_axis(ways, step[:, :, None], 2)[:, :, 0] + part[:m, t - a]
        label, path = best.argmax(1), np.zeros((longest, n), np.int8)
        for t in range(longest - 1, -1, -1):
            m = live[t]
            path[t, :m] = label[:m]
            if t:
                label[:m] = back[t, every[:m], label[:m]]
        return path


def train(rows: list[tuple[int, str, str]], steps: int = 120, rate: float = 0.5, pull: float = 1e-3) -> Field:
    """Maximum likelihood by gradient ascent with forward-backward over all sentences at once. rows: (sentence, token, label) in order."""
    by: dict[int, list[tuple[str, str]]] = {}
    for sentence, token, label in rows:
        by.setdefault(sentence, []).append((token, label))
    sentences = [x for x in by.values() if x]
    names: dict[str, int] = {}
    marked = [[[names.setdefault(f, len(names)) for f in row] for row in features([t for t, _ in s])] for s in sentences]
    n, longest, labels = len(sentences), max(map(len, sentences), default=1), len(LABELS)
    gold, lengths = np.zeros((n, longest), np.int64), np.array([len(s) for s in sentences])
    at_token, at_feature = [], []
    for i, s in enumerate(sentences):
        for t, (_, label) in enumerate(s):
            gold[i, t] = LABELS.index(label)
            at_token += [i * longest + t] * len(marked[i][t])
            at_feature += marked[i][t]
    at_token, at_feature = np.array(at_token, np.int64), np.array(at_feature, np.int64)
    mask = np.arange(longest)[None] < lengths[:, None]
    emit, move = np.zeros((len(names), labels)), np.zeros((labels, labels))
    seen_emit, seen_move = np.full(emit.shape, 1e-6), np.full(move.shape, 1e-6)
    truth = np.eye(labels)[gold] * mask[:, :, None]
    truth_moves = np.einsum("ita,itb->ab", truth[:, :-1], truth[:, 1:])
    for _ in range(steps):
        score = np.zeros((n * longest, labels))
        np.add.at(score, at_token, emit[at_feature])
        score = score.reshape(n, longest, labels)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            ways = forward[:, t - 1, :, None] + move
            top = ways.max(1)
            forward[:, t] = np.where(mask[:, t, None], top + np.log(np.exp(ways - top[:, None]).sum(1)) + score[:, t], forward[:, t - 1])
        top = forward[:, -1].max(1)
        total = top + np.log(np.exp(forward[:, -1] - top[:, None]).sum(1))
        moves = np.zeros_like(move)
        for t in range(longest - 2, -1, -1):
            ways = move[None] + (score[:, t + 1] + backward[:, t + 1])[:, None, :]
            top = ways.max(2)
            backward[:, t] = np.where(mask[:, t + 1, None], top + np.log(np.exp(ways - top[:, :, None]).sum(2)), 0)
            pair = np.exp(forward[:, t, :, None] + ways - total[:, None, None]) * mask[:, t + 1, None, None]
            moves += pair.sum(0)
        share = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
        lean = (truth - share).reshape(-1, labels)
        g = np.zeros_like(emit)
        np.add.at(g, at_feature, lean[at_token])
        g, h = g / n - pull * emit, (truth_moves - moves) / n - pull * move
        seen_emit += g * g
        seen_move += h * h
        emit += rate * g / np.sqrt(seen_emit)
        move += rate * h / np.sqrt(seen_move)
    return Field(names, emit, move)


# ---------------------------------------------------------------- scanning


class Reader(dict):
    """From tokens to 64 times the number of the shape plus that of the cue."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field

    def __missing__(self, token: str) -> int:
        got = 64 * self.field.shapes.get(shape(token), 0) + self.field.cues.get(token.lower(), 0)
        if len(token) <= SHORT:
            if len(self) > CACHED:
                self.clear()
            self[token] = got
        return got

    def read(self, text: str) -> np.ndarray:
        tokens = _TOKEN.findall(text)
        return np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))


_READERS: dict[int, Reader] = {}


def _reader(field: Field) -> Reader:
    """One for each worker process and field."""
    if id(field) not in _READERS or _READERS[id(field)].field is not field:
        _READERS.clear()
        _READERS[id(field)] = Reader(field)
    return _READERS[id(field)]


def spans_of(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """For each text its pattern spans and the field's further spans."""
    base, reader = [base_spans(t) for t in texts], _reader(field)
    more: list[list] = [[] for _ in texts]
    wanted = np.array([LABELS.index(kind) for kind in ADDED], np.int8)
    for k, labels in enumerate(field.labels([reader.read(t) for t in texts])):
        hits = np.flatnonzero(np.isin(labels, wanted))
        if not len(hits):
            continue
        places = [m.span() for m, _ in zip(_TOKEN.finditer(texts[k]), range(hits[-1] + 1))]
        for run in np.split(hits, np.flatnonzero((np.diff(hits) > 1) | (np.diff(labels[hits]) != 0)) + 1):
            kind, a, b = LABELS[labels[run[0]]], places[run[0]][0], places[run[-1]][1]
            digits = sum(map(str.isdigit, texts[k][a:b]))
            if (kind != "phone" or 8 <= digits <= 15) and (kind != "ssn" or digits == 9) and (kind != "secret" or b - a >= 12):
                if not any(x < b and a < y for _, x, y in base[k]):
                    more[k].append((kind, a, b))
    return list(zip(base, more))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _some(texts: list[str], most: int = 1 << 22) -> Iterator[list[str]]:
    """The texts in order, some ``most`` characters at a time."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def find(docs: DataFrame, table: list[tuple[int, str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (of the patterns), base_sha256, spans, n_added."""
    field = docs.sparkSession.sparkContext.broadcast(train(labelled_table() if table is None else table))

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for base, more in (x for some in _some(texts.tolist()) for x in spans_of(some, field.value)):
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS[:4]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), of(text_of(F.col(f"`{text_col}`"))).alias("p")).select("doc_id", "p.*")


def redacted(text: str, spans: str) -> str:
    """A text with each span replaced by its kind in brackets."""
    out, at = [], 0
    parts = (s.split(":") for s in spans.split(",") if s)
    for a, b, kind in sorted((int(a), int(b), kind) for kind, a, b in parts):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])
