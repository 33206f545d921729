"""URL filter: a weighted vocabulary counted by an Aho-Corasick automaton, overridden by host and path rules."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import LOWER, UPPER, fresh

#: topics a site names itself by, no word of trade, technology or site structure (see README)
#: one of these rejects; whole words between non-alphanumeric characters
STRICT = ("casino", "cialis", "hentai", "porn", "viagra", "warez", "xxx")
#: two different ones reject; "free" is the only one that is no topic, so one of the two always is
SOFT = ("adult", "bet", "bets", "betting", "dating", "escort", "free", "gambling", "jackpot", "lottery", "nude", "pharmacy", "pills", "poker", "sex", "slots")
SOFT_HITS = 2
#: (verdict, host and path); the path begins at the first slash
Rules = Sequence[tuple[str, str]]
_FOLD = str.maketrans(UPPER, LOWER)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [rest.find(c) for c in "/?#"]
    end = min((e for e in ends if e >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    ends = [rest.find(c) for c in "?#"]
    return host.translate(_FOLD), rest[: min((e for e in ends if e >= 0), default=len(rest))]


class Filter:
    def __init__(self, strict: Sequence[str], soft: Sequence[str], soft_hits: int, rules: Rules):
        self.words = ahocorasick.Automaton()
        for weight, terms in ((0, soft), (1, strict)):
            for term in terms:
                self.words.add_word(term.translate(_FOLD), (term.translate(_FOLD), weight))
        self.words.make_automaton()
        self.any_words = bool(strict or soft)
        self.soft_hits = soft_hits
        self.rules: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.rules.setdefault(host.translate(_FOLD), []).append((slash + path, rule, verdict))

    def hits(self, text: str) -> tuple[list[str], list[str]]:
        """Distinct strict and soft terms that stand between borders."""
        found: tuple[set[str], set[str]] = (set(), set())
        alnum = lambda c: c.isascii() and c.isalnum()
        for end, (term, weight) in self.words.iter(text) if self.any_words else ():
            start = end - len(term) + 1
            if (start == 0 or not alnum(text[start - 1])) and (end + 1 == len(text) or not alnum(text[end + 1])):
                found[weight].add(term)
        return sorted(found[1]), sorted(found[0])

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule (text, verdict) for the host or a domain above it; of equal ones the first given."""
        best, name = None, host
        while name:
            for start, rule, verdict in self.rules.get(name, ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
            name = name.partition(".")[2]
        return best

    def judge(self, url: str | None) -> tuple:
        host, path = split_url(url)
        strict, soft = self.hits((host + path).translate(_FOLD))
        rule = self.rule(host, path)
        verdict = rule[1] if rule else "block" if strict or len(soft) >= self.soft_hits else "allow"
        return host, path, rule[0] if rule else None, verdict, strict, soft


def judge_urls(pages: DataFrame, url_col: str = "url", strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_hits: int = SOFT_HITS, rules: Rules = ()) -> DataFrame:
    """``pages`` with host, path, rule, verdict, strict_hits and soft_hits; columns of these names are replaced.

    Host and path are searched for the vocabulary, the query string and the fragment are not: they carry tracking words on clean
    pages. One strict term or ``soft_hits`` different soft terms block. A rule fits its host and all subdomains if the path starts
    with the rule's path; the longest rule decides instead of the vocabulary. Vocabulary and rules are parameters
    and go to the tasks with the function. Null and empty urls have empty host and path and are allowed. No shuffle.
    """

    @F.pandas_udf("host string, path string, rule string, verdict string, strict_hits array<string>, soft_hits array<string>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Filter(strict, soft, soft_hits, rules)
        for urls in batches:
            yield pd.DataFrame([own.judge(u) for u in urls], columns=["host", "path", "rule", "verdict", "strict_hits", "soft_hits"])

    (work,) = fresh(pages, "judged")
    names = ("host", "path", "rule", "verdict", "strict_hits", "soft_hits")
    return pages.withColumn(work, of(F.col(url_col))).withColumns({n: F.col(work)[n] for n in names}).drop(work)
