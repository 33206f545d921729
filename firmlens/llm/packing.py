"""Packing of token sequences by dominance reduction on the length histogram, then best fit.

Which documents have which length does not matter for the number of sequences, so the plan is made from the histogram of
piece lengths: at most ``capacity`` numbers, whatever the corpus. The plan says how many sequences have which mix
of lengths; every piece finds its place from its length and its rank among the pieces of that length, which is
computed without gathering a length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm import bpe
from firmlens.session import cut_lineage

CAPACITY, END_ID = 1024, 2
BLOCK = 64
#: white-space runs beyond this overflow the stack of the library's matcher; such texts go through the other encoder
LONG_RUN = re.compile(r"\s{2000}")
PIECE = "part int, slot long, {id} {id_type}, piece int, start long, length long, ids_crc32 long, nth long"

Pattern = tuple[tuple[int, ...], int]


class Sizes:
    """Multiset of sizes with the largest size up to a bound."""

    def __init__(self, histogram: dict[int, int]):
        self.n = {s: c for s, c in histogram.items() if c}
        self.order = sorted(self.n)

    def take(self, size: int, count: int) -> None:
        self.n[size] -= count
        if not self.n[size]:
            del self.n[size]
            self.order.pop(bisect_left(self.order, size))

    def up_to(self, bound: int, without: dict[int, int]) -> int:
        """Largest size <= bound that is left after ``without``; 0 if none."""
        at = bisect_left(self.order, bound + 1) - 1
        while at >= 0 and self.n[self.order[at]] <= without.get(self.order[at], 0):
            at -= 1
        return self.order[at] if at >= 0 else 0

    def above(self, bound: int, without: dict[int, int], how_many: int) -> list[int]:
        """The smallest ``how_many`` sizes over ``bound`` left after ``without``, repeats included."""
        out: list[int] = []
        for size in self.order[bisect_left(self.order, bound + 1) :]:
            out += [size] * min(how_many - len(out), self.n[size] - without.get(size, 0))
            if len(out) >= how_many:
                break
        return out


def _dominating(sizes: Sizes, j: int, room: int) -> tuple[int, ...] | None:
    """The other sizes of a set with ``j`` that dominates every other set with ``j``, or None if three rules prove none.

    Removing more documents never adds alternatives, so a set that dominates stays so while its sizes last.
    """
    own = {j: 1}
    best = sizes.up_to(room, own)
    if not best:
        return ()  # nothing fits beside j
    smallest = sizes.above(0, own, 3)
    if best == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return (best,)  # fills the sequence, or only one more fits and this is the largest
    if len(smallest) == 3 and sum(smallest) <= room:
        return None
    # at most two more fit: compare with all pairs
    with_best = own | {best: 1 + own.get(best, 0)}
    second = sizes.up_to(room - best, with_best)
    larger = sizes.above(second, own, 2)
    if second:  # (best, second) beats every pair whose smaller member is at most second; is there another pair?
        return (best, second) if len(larger) < 2 or sum(larger) > room else None
    # nothing fits beside best: it beats a pair only if the pair's sum is not larger
    top = 0
    for a in sizes.order[: bisect_left(sizes.order, room)]:
        b = sizes.up_to(room - a, own | {a: 1 + own.get(a, 0)})
        if b and sizes.n[a] > own.get(a, 0):
            top = max(top, a + b)
    return (best,) if top <= best else None


def reduce_by_dominance(histogram: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Martello-Toth reduction: sequences that some optimal packing has, and the histogram of what remains."""
    sizes, fixed = Sizes(histogram), []
    again = True
    while again:
        again = False
        for j in sorted(sizes.n, reverse=True):
            while j in sizes.n:
                others = _dominating(sizes, j, capacity - j)
                if others is None:
                    break
                need: dict[int, int] = {}
                for s in (j, *others):
                    need[s] = need.get(s, 0) + 1
                # a set without others holds for all of j only while even the smallest other document, or j itself, doesn't fit
                times = min(sizes.n[s] // k for s, k in need.items())
                for s, k in need.items():
                    sizes.take(s, k * times)
                fixed.append(((j, *others), times))
                again = True
    return fixed, dict(sizes.n)


def best_fit(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit by decreasing size, all sequences with the same remaining room at once."""
    open_bins: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, content: tuple[int, ...], count: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append([content, count])

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                if left >= each:
                    put(capacity - each * size, (size,) * each, left // each)
                if left % each:
                    put(capacity - left % each * size, (size,) * (left % each), 1)
                break
            room = rooms[at]
            group = open_bins[room][-1]
            each = min(room // size, left)
            count = min(group[1], left // each)
            group[1] -= count
            if not group[1]:
                open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            put(room - each * size, group[0] + (size,) * each, count)
            left -= each * count
    return [(content, count) for groups in open_bins.values() for content, count in groups]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """How many sequences hold which lengths; every document of the histogram is in exactly one."""
    fixed, rest = reduce_by_dominance(histogram, capacity)
    return fixed + best_fit(rest, capacity)


def places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank of each run, the sequence of that rank, and the offset that the run has in its sequences."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for content, count in patterns:
        offset = 0
        for size in content:
            runs.setdefault(size, []).append((used.get(size, 0), base, offset))
            used[size] = used.get(size, 0) + count
            offset += size
        base += count
    return {size: tuple(np.array(x, np.int64) for x in zip(*r)) for size, r in runs.items()}


class Tokenizer:
    def __init__(self, path: str):
        own = bpe.codec(path)
        ranks = {own.blob[own.offsets[i] : own.offsets[i + 1]].tobytes(): i for i in own.vocab.values()}
        self._own = own
        self._library = tiktoken.Encoding("packing", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens=own.special)
        self._special = "all" if own.special else set()

    def encode(self, text: str) -> np.ndarray:
        if LONG_RUN.search(text):
            return self._own.encode(text)
        return np.frombuffer(self._library.encode_to_numpy(text, allowed_special=self._special), np.uint32)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole sequences from the end, so only the first piece may be shorter."""
    first = n_tokens % capacity or min(n_tokens, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n_tokens, capacity)]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its checksum and ``nth``, its rank among the pieces of its length in this task."""
    kind = docs.schema[id_col].dataType
    schema = PIECE.format(id="id", id_type=kind.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, own, tail = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), tokenizer(path), np.array([end_id], np.uint32)
        slot = 0
        for batch in batches:
            rows = []
            for at, text in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate([own.encode(text or ""), tail]).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((at, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), seen[length]))
                    seen[length] += 1
            at, k, start, length, crc, nth = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.empty(0, np.int64),) * 6
            slots = np.arange(slot, slot + len(at))
            slot += len(at)
            out = [pa.array(np.full(len(at), part, np.int32)), pa.array(slots), batch.column(0).take(pa.array(at)), pa.array(k.astype(np.int32)), *map(pa.array, (start, length, crc, nth))]
            yield pa.RecordBatch.from_arrays(out, ["part", "slot", "id", "piece", "start", "length", "ids_crc32", "nth"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every document in sequences of at most ``capacity`` tokens: (id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its tokens and ``end_id``; only longer ones are cut. Null text is empty (one token). Rows with repeated or
    null ids are documents of their own. An empty table gives an empty result. Other columns are not read. The driver sees
    the histogram of lengths only.
    """
    rows = cut_lineage(pieces(docs, path, id_col, text_col, capacity, end_id))
    per_part = rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(plan(histogram, capacity))
    # ranks: what earlier parts have of the length, looked up for blocks of BLOCK pieces so that no length is hot
    before = per_part.select("part", "length", "n", F.expr("sum(n) over (partition by length order by part) - n").alias("before"))
    blocks = before.select("part", "length", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}"))).alias("block"))
    ranked = rows.withColumn("block", F.expr(f"nth div {BLOCK}")).join(blocks, ["part", "length", "block"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for one in np.unique(lengths):
            mine = lengths == one
            first, base, at = where[int(one)]
            run = np.searchsorted(first, ranks[mine], side="right") - 1
            sequence[mine], offset[mine] = base[run] + ranks[mine] - first[run], at[run]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("place", place("length", F.col("before") + F.col("nth")))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
