"""Byte-level BPE by backtracking over longest matches, and decoding by an offset table.

A word's tokens are taken greedily: an Aho-Corasick automaton gives the longest vocabulary match at every byte, and a match
is kept only if it is compatible with the token before it. Two tokens are compatible when no merge across their border would
have come before the merges that made them. If none fits, the encoder steps back to a shorter match; a byte position is
given up at most once, so the time is linear in the word. The result equals applying the merges in rank order.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import fresh

CACHE_WORDS = 600_000
CACHE_WORD_CHARS = 64
LONG_TEXT = 1 << 20
#: fixed values: the public pattern that cuts text into words, and the same for texts of printable ASCII and Latin letters only
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+"
_NOT_LATIN = re.compile("[^\t\n\r -~À-ɏ]")
_WORDS, _LATIN_WORDS = regex.compile(PATTERN), re.compile(LATIN_PATTERN)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next letter from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(plain)))
    return [out[b] for b in range(256)]


class Codec:
    """Tables of one byte-level vocabulary file; ids must be in merge order, as in the public files."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        alphabet = byte_alphabet()
        self._letters, self._space = dict(enumerate(alphabet)), alphabet[32]
        self.vocab = vocab
        self.left = list(range(self.size))
        self.right = list(range(self.size))
        self.merged: dict[int, int] = {}
        last = -1
        for a, b in merges:
            one = vocab[a + b]
            if one <= last:
                raise ValueError("ids are not in merge order")
            last = one
            self.left[one], self.right[one] = vocab[a], vocab[b]
            self.merged[vocab[a] * self.size + vocab[b]] = one
        self.matches = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.matches.add_word(token, i)
        self.matches.make_automaton()
        self.length = [0] * self.size
        self.shorter = [-1] * self.size
        for token, i in vocab.items():
            self.length[i] = len(token)
            self.shorter[i] = next((vocab[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in vocab), -1)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._fits: dict[int, bool] = {}
        self._cache: dict[str, bytes] = {}
        back = {c: b for b, c in enumerate(alphabet)}
        pieces = [b""] * self.size
        for token, i in vocab.items():
            pieces[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b stay apart: undo their last merges, latest first, until a pair across the border would have merged
        earlier (no), or the two cannot be undone any more (yes)."""
        key = a * self.size + b
        known = self._fits.get(key)
        if known is not None:
            return known
        left, right, merged, size = self.left, self.right, self.merged, self.size
        limit, ok = size, True
        while True:
            one = merged.get(a * size + b)
            if one is not None and one < limit:
                ok = False
                break
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        break
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        break
        if len(self._fits) < 4 * CACHE_WORDS:
            self._fits[key] = ok
        return ok

    def word(self, word: str) -> list[int]:
        """Token ids of one word: the longest matches from left to right if all of them fit, else by stepping back."""
        if word.isascii() and word.isprintable() and " " not in word[1:]:
            letters = self._space + word[1:] if word[0] == " " else word
        else:
            letters = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._letters)
        greedy = [i for _, i in self.matches.iter_long(letters)]
        known, size, before = self._fits, self.size, -1
        for i in greedy:
            if before >= 0:
                ok = known.get(before * size + i)
                if not (self.fits(before, i) if ok is None else ok):
                    return self._step_back(letters)
            before = i
        return greedy

    def _step_back(self, letters: str) -> list[int]:
        longest = [0] * len(letters)
        length, shorter, known, size = self.length, self.shorter, self._fits, self.size
        for end, i in self.matches.iter(letters):
            longest[end - length[i] + 1] = i
        out: list[int] = []
        open_at = bytearray(b"\x01") * (len(letters) + 1)
        at, token = 0, longest[0]
        while at < len(letters):
            while True:
                end = at + length[token]
                if open_at[end]:
                    ok = known.get(out[-1] * size + token) if out else True
                    if self.fits(out[-1], token) if ok is None else ok:
                        out.append(token)
                        at = end
                        token = longest[at] if at < len(letters) else -1
                        break
                if shorter[token] >= 0:
                    token = shorter[token]
                    continue
                open_at[at] = 0
                token = out.pop()
                at -= length[token]
                break
        return out

    def _packed(self, word: str) -> bytes:
        got = array("I", self.word(word)).tobytes()
        if len(word) <= CACHE_WORD_CHARS:
            if len(self._cache) >= CACHE_WORDS:
                self._cache.clear()
            self._cache[word] = got
        return got

    def _plain(self, text: str) -> list[bytes]:
        pattern = _WORDS if _NOT_LATIN.search(text) else _LATIN_WORDS
        if len(text) <= LONG_TEXT:
            words = pattern.findall(text)
            found = list(map(self._cache.get, words))
            if None in found:
                found = [x if x is not None else self._cache.get(w) or self._packed(w) for x, w in zip(found, words)]
            return found
        found = []
        for m in pattern.finditer(text):
            found.append(self._cache.get(m.group()) or self._packed(m.group()))
            if len(found) > LONG_TEXT:
                found = [b"".join(found)]
        return found

    def encode(self, text: str) -> np.ndarray:
        if not self._special:
            return np.frombuffer(b"".join(self._plain(text)), np.uint32)
        out: list[bytes] = []
        for i, part in enumerate(self._special.split(text)):
            if i % 2:
                out.append(np.uint32(self.special[part]).tobytes())
            elif part:
                out += self._plain(part)
        return np.frombuffer(b"".join(out), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a token sequence: one gather from the joined vocabulary, a block of ids at a time."""
        out = []
        for at in range(0, len(ids), LONG_TEXT):
            part = ids[at : at + LONG_TEXT]
            starts = self.offsets[part]
            lengths = self.offsets[part + np.uint32(1)] - starts
            ends = np.cumsum(lengths)
            where = np.repeat(starts - (ends - lengths), lengths)
            where += np.arange(len(where))
            out.append(self.blob[where].tobytes())
        return b"".join(out)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with the token ids of each text (array<int>) and the text that these ids decode to.

    Null text is empty: no ids, empty decoded text. Strings of special tokens become those tokens, and no other token is
    added. Columns named like the new ones are replaced. The vocabulary file must be at ``path`` on every executor.
    """

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for batch in texts:
            ids = [own.encode(t or "") for t in batch.to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.int32)
            decoded = pa.array([own.decode(x).decode("utf-8", "replace") for x in ids], pa.string())
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), decoded], ["ids", "decoded"])

    (work,) = fresh(docs, "coded")
    return docs.withColumn(work, both(F.col(text_col))).withColumns({ids_col: F.col(work)["ids"], decoded_col: F.col(work)["decoded"]}).drop(work)
