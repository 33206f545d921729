"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots: word starts and continuations. Every node knows where to go when the next letter does not
fit (its failure link) and how many pieces are complete by then (its popped count). Counting the pieces of a word is one walk
over its letters that adds popped counts; no piece is ever built and no letter is read twice.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.bpe import byte_alphabet
from firmlens.llm.common import fresh

CACHE_WORDS, CACHE_WORD_CHARS = 500_000, 64
LETTERS = 1 << 21
BLOCK = 1 << 20


class Automaton:
    """Greedy longest-match counts for pieces that start a word and pieces that continue one."""

    def __init__(self, starts: Iterable[str], continues: Iterable[str]):
        self.step: dict[int, int] = {}
        complete: list[bool] = [False, False]
        children: list[list[tuple[str, int]]] = [[], []]
        for root, pieces in ((0, starts), (1, continues)):
            for piece in pieces:
                at = root
                for c in piece:
                    key = at * LETTERS + ord(c)
                    after = self.step.get(key)
                    if after is None:
                        after = self.step[key] = len(complete)
                        complete.append(False)
                        children.append([])
                        children[at].append((c, after))
                    at = after
                complete[at] = at > 1
        #: -1: no way on, the word is unknown
        self.fail, self.popped = [-1] * len(complete), [0] * len(complete)
        queue = deque((0, 1))
        while queue:
            u = queue.popleft()
            for c, v in children[u]:
                queue.append(v)
                if complete[v]:
                    self.fail[v], self.popped[v] = 1, 1
                    continue
                z, count = self.fail[u], self.popped[u]
                while z >= 0 and z * LETTERS + ord(c) not in self.step:
                    count += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.step[z * LETTERS + ord(c)], count

    def count(self, word: str) -> int:
        """Number of pieces of a word; an unknown word is one piece, the empty word none."""
        if not word:
            return 0
        step, fail, popped = self.step, self.fail, self.popped
        at = total = 0
        for c in word:
            after = step.get(at * LETTERS + ord(c))
            while after is None:
                total += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
                after = step.get(at * LETTERS + ord(c))
            at = after
        while at != 1:
            total += popped[at]
            at = fail[at]
            if at < 0:
                return 1
        return total


class Counter:
    """Counts over the words of a text; words are runs of anything but white space, in byte letters behind a word-start mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = byte_alphabet()
        self._letters, self._mark = dict(enumerate(letters)), letters[32]
        self._automaton = Automaton([p for p in vocab if p[0] == self._mark], [p for p in vocab if p[0] != self._mark])
        self._known: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = self._automaton.count(self._mark + word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._letters))
        if len(word) <= CACHE_WORD_CHARS:
            if len(self._known) >= CACHE_WORDS:
                self._known.clear()
            self._known[word] = n
        return n

    def text(self, text: str) -> tuple[int, int]:
        """(words, tokens); a long text is cut at white space, a block at a time."""
        words = tokens = at = 0
        while at < len(text):
            end = min(len(text), at + BLOCK)
            while end < len(text) and not text[end].isspace():
                end += 1
            part = text[at:end].split()
            at = end
            found = list(map(self._known.get, part))
            if None in found:
                found = [n if n is not None else self.word(w) for n, w in zip(found, part)]
            words += len(part)
            tokens += sum(found)
        return words, tokens


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", words_col: str = "n_words", tokens_col: str = "n_tokens") -> DataFrame:
    """``docs`` with the numbers of words and of greedy longest-match tokens of each text (columns of these names are replaced).

    The vocabulary is that of a byte-level tokenizers file: every byte is a piece, so no word is unknown. Null and empty
    texts have neither words nor tokens. Repeated rows are counted alike; nothing is shuffled. The file must be at ``path`` on every
    executor.
    """

    @F.pandas_udf("words long, tokens long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        for texts in batches:
            yield pd.DataFrame([own.text(t or "") for t in texts], columns=["words", "tokens"], dtype="int64")

    (work,) = fresh(docs, "counted")
    return docs.withColumn(work, of(F.col(text_col))).withColumns({words_col: F.col(work)["words"], tokens_col: F.col(work)["tokens"]}).drop(work)
