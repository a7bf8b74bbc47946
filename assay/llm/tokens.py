"""Token ids of whole texts by a public tokenizer file, with each distinct word encoded once per worker."""

from __future__ import annotations

import unicodedata

import numpy as np
import regex

#: Entries a worker keeps of each cache before it starts afresh; bounds memory, changes no result.
CACHED = 150_000
#: A chunk that the tokenizer certainly cuts into one run of letters and one of signs: no digits, apostrophes or blanks.
_PLAIN = regex.compile(r"(\p{L}*)([^\s\p{L}\p{N}'<]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()


class WordTokens(dict):
    """From a chunk without ASCII blanks to its ids (little-endian 32-bit bytes), for a lower-casing word BPE that drops blanks and never
    merges across them. A run of letters or signs goes straight to the vocabulary's merges; any other chunk takes the whole way."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.runs: dict[str, bytes] = {}

    def _run(self, run: str) -> bytes:
        got = self.runs.get(run)
        if got is None:
            if len(self.runs) > CACHED:
                self.runs.clear()
            letters = run if run.isascii() and run.isprintable() else run.encode("utf-8").decode("latin-1").translate(_LETTERS)
            got = self.runs[run] = np.array([t.id for t in self.merges(letters)], "<u4").tobytes()
        return got

    def __missing__(self, chunk: bytes) -> bytes:
        word = chunk.decode("utf-8", "replace")
        low = word.lower()
        if not (low.isascii() or ("Σ" not in word and unicodedata.is_normalized("NFC", word))):
            got = self._whole(word)
        elif low.isalpha():
            got = self._run(low)
        elif found := _PLAIN.fullmatch(low):
            got = b"".join([self._run(x) for x in found.groups() if x])
        else:
            got = self._whole(word)
        self[chunk] = got
        return got

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if len(self) > CACHED:
            self.clear()
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))


_OPEN: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One tokenizer and cache for each worker process."""
    if path not in _OPEN:
        _OPEN[path] = WordTokens(path)
    return _OPEN[path]
