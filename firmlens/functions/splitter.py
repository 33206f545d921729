"""Separator-aware splitting of one text into overlapping spans.

Pieces are cut at the coarsest separator that occurs; a piece that is still too
long is cut again at the next finer one, down to single characters. Neighbouring
pieces are then packed into spans of at most ``size`` characters, and each new
span reaches back over whole pieces worth up to ``overlap`` characters. Spans are
(start, end) offsets without surrounding white space.
"""

from __future__ import annotations

import re

# Separators from coarse to fine, as patterns.
SEPARATORS = [r"\n\n\n", r"\n \n \n", r"\n\n", r"\n \n", r"\. ", r"; ", r"\n"]
MARKDOWN_SEPARATORS = [
    r"\n#{1,6} ", r"```\n", r"\n\*\*\*+\n", r"\n---+\n", r"\n___+\n", r"\n\n", r"\n", r" ", r"",
]

Span = tuple[int, int]


def _cut(text: str, start: int, end: int, separator: str) -> list[Span]:
    """Pieces of text[start:end]; a separator stays at the front of the piece it opens."""
    if not separator:
        return [(i, i + 1) for i in range(start, end)]
    marks = [m.start() for m in re.compile(separator).finditer(text, start, end)]
    marks = [start, *[m for m in marks if m > start], end]
    return list(zip(marks, marks[1:]))


def _pack(pieces: list[Span], size: int, overlap: int) -> list[Span]:
    """Join neighbouring pieces into spans of at most ``size`` with whole-piece overlap."""
    out: list[Span] = []
    first = 0
    for i, (_, end) in enumerate(pieces):
        if first < i and end - pieces[first][0] > size:
            out.append((pieces[first][0], pieces[i - 1][1]))
            while first < i and (pieces[i - 1][1] - pieces[first][0] > overlap or end - pieces[first][0] > size):
                first += 1
    if first < len(pieces):
        out.append((pieces[first][0], pieces[-1][1]))
    return out


def _split(text: str, start: int, end: int, size: int, overlap: int, separators: list[str]) -> list[Span]:
    depth = next((i for i, s in enumerate(separators) if not s or re.compile(s).search(text, start, end)), len(separators) - 1)
    finer = separators[depth + 1 :]
    out: list[Span] = []
    short: list[Span] = []
    for piece in _cut(text, start, end, separators[depth]):
        if piece[1] - piece[0] < size:
            short.append(piece)
            continue
        out += _pack(short, size, overlap)
        short = []
        out += _split(text, *piece, size, overlap, finer) if finer else [piece]
    return out + _pack(short, size, overlap)


def split_spans(text: str, size: int, overlap: int, separators: list[str]) -> list[Span]:
    """Stripped, non-empty (start, end) spans of ``text``."""
    out = []
    for a, b in _split(text, 0, len(text), size, overlap, separators):
        body = text[a:b]
        a += len(body) - len(body.lstrip())
        b -= len(body) - len(body.rstrip())
        if b > a:
            out.append((a, b))
    return out
