"""Token ids in raw binary shards with a minimal perfect hash index.

A shard file holds, little endian: a header, the index, and the ids of its documents one after the other in ascending order of
document id. The index is a minimal perfect hash of the shard's distinct keys (hash and displace: keys are put in small buckets,
large buckets first get a displacement under which all their keys fall on free slots, buckets of one key name their slot). A
slot holds a fingerprint of its key, the key's first document and how many documents share the key, so a key is found in
constant time, a foreign key is told by its fingerprint, and the document's ids are one slice of the payload.

Shards are written by Spark's text writer as one line each, so the file system, the commit and retries are Spark's own.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import regex
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from firmlens.llm.bpe import byte_alphabet
from firmlens.llm.common import shuffle_partitions
from firmlens.operators.scale import running_before
from firmlens.session import cut_lineage

#: a shard is closed beyond so many ids or documents
SHARD_IDS, SHARD_DOCS = 4_000_000, 100_000
ROUTES = 100_000
KEYS_PER_BUCKET = 2
#: fixed value of the tokenizer file that has a quicker way: contractions, words, single digits, runs of marks
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MAGIC = b"IDSHARD1"
_HEADER = struct.Struct("<8sIIIIIIQ")  # magic, bytes per id, documents, keys, buckets, seed, bytes of key names, ids
_NULL = 0xFFFFFFFF  # length of the null key's name
_MASK, _STEP, _MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


# --- encoding ---------------------------------------------------------------------------------------------------------------

#: letters from here on, those whose lower case is more than a letter, and separators that Python's split takes for white space go to the library
_PLAIN = 0x250
_UNFOLDED = "".join(c for c in map(chr, range(_PLAIN)) if len(c.lower()) > 1)
_FOREIGN = re.compile(f"[\x1c-\x1f{_UNFOLDED}{chr(_PLAIN)}-\U0010ffff]")
#: longer words go to the library
WORD_CHARS = 400
CACHE_MARKS = 100_000


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, as raw bytes of 2 or 4 an id, with an end id behind each.

    For files whose words are lower-cased matches of one pattern between white space, plain words are put one space apart and merged
    by tiktoken from the file's own merges (equal ids, several times faster); all else goes to the library.
    """

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        size = max(self._library.get_vocab_size(with_added_tokens=True), end + 1)
        self.type = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self._end = np.array([end], self.type).tobytes()
        self._quick = _Words.of(path)

    def _whole(self, text: str) -> bytes:
        return np.array(self._library.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _text(self, text: str) -> bytes:
        if self._quick is None:
            return self._whole(text)
        if not self._quick.foreign(text):
            words = self._quick.words(text)
            if max(map(len, words), default=0) <= WORD_CHARS:
                return np.array(self._quick.ids(words), self.type).tobytes()
        # white space never joins, so runs of plain and of other parts are encoded apart
        out = []
        for other, run in groupby(re.split(r"[ \t\n]+", text), self._quick.foreign):
            part = " ".join(run)
            words = [] if other else self._quick.words(part)
            by_library = other or max(map(len, words), default=0) > WORD_CHARS
            out.append(self._whole(part) if by_library else np.array(self._quick.ids(words), self.type).tobytes())
        return b"".join(out)

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null is empty."""
        return [self._text(t or "") + self._end for t in texts]


class _Words:
    """Words of plain text and their ids. A word ends in a space, which stands for the mark of word ends in the file's tokens."""

    def __init__(self, pattern: str, vocab: dict[str, int], suffix: str, special: list[str]):
        self._pattern, self._special = regex.compile(pattern), special
        marks = "".join(re.escape(chr(c)) for c in range(_PLAIN) if not regex.match(r"\p{L}|\s", chr(c)) and not 0x1C <= c <= 0x1F)
        #: what is no letter, with the letters of a contraction that may follow
        self._marks = re.compile(f"[{marks}]+(?:(?<=')(?:s|t|re|ve|m|ll|d))?")
        self._apart: dict[str, str] = {}
        letters = {c: i for i, c in enumerate(byte_alphabet())}
        ranks = {b" ": len(vocab)}
        for token, i in vocab.items():
            if token not in special:
                body = bytes(letters[c] for c in token.removesuffix(suffix))
                if b" " not in body:
                    ranks[body + b" " * token.endswith(suffix)] = i
        self._merge = tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @classmethod
    def of(cls, path: str) -> _Words | None:
        """For files that compose, lower-case, take matches of one pattern and mark word ends, with merges in order of id."""
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, special = file["model"], [t["content"] for t in file.get("added_tokens") or []]
        steps = [n["type"] for n in (file.get("normalizer") or {}).get("normalizers", [])]
        cuts = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or any(re.search(r"\s", s) for s in special):
            return None
        pattern, suffix, vocab = cuts[0]["pattern"].get("Regex"), model.get("end_of_word_suffix"), model["vocab"]
        if pattern != WORD_PATTERN or cuts[0]["behavior"] != "Removed" or not cuts[0]["invert"] or cuts[1]["use_regex"] or cuts[1]["add_prefix_space"] or not suffix:
            return None
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        ends = [vocab.get(c + suffix, len(vocab)) for c in byte_alphabet()]
        return cls(pattern, vocab, suffix, special) if merged == sorted(merged) and max(ends) < merged[0] else None

    def foreign(self, text: str) -> bool:
        return _FOREIGN.search(text) is not None or any(s in text for s in self._special)

    def _spaced(self, m: re.Match) -> str:
        found = self._apart.get(m[0])
        if found is None:
            parts = self._pattern.findall(m[0])
            # letters behind a run of marks are no contraction: they go on with the word
            found = f" {' '.join(parts)}{'' if m[0][-1].isalpha() and parts[-1][0] != chr(39) else ' '}"
            if len(self._apart) < CACHE_MARKS and len(found) < WORD_CHARS:
                self._apart[m[0]] = found
        return found

    def words(self, text: str) -> list[str]:
        return self._marks.sub(self._spaced, text.lower()).split()

    def ids(self, words: list[str]) -> list[int]:
        return self._merge(" ".join(words) + " ") if words else []


@lru_cache(maxsize=2)
def encoder(path: str, end: int) -> Encoder:
    return Encoder(path, end)


# --- minimal perfect hash ---------------------------------------------------------------------------------------------------


def _hashes(names: list[bytes | None], seed: int) -> np.ndarray:
    """Two 64-bit hashes of every key; null differs from every name."""
    digests = b"".join(xxhash.xxh3_128_digest(b"\x00" if n is None else b"\x01" + n, seed) for n in names)
    return np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)


def _slot(h: int, displacement: int, n: int) -> int:
    x = (h + displacement * _STEP) & _MASK
    return (((x ^ (x >> 32)) * _MIX & _MASK) >> 17) % n


def _slots(h: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    x = h + displacement.astype(np.uint64) * np.uint64(_STEP)
    return (((x ^ (x >> np.uint64(32))) * np.uint64(_MIX)) >> np.uint64(17)) % np.uint64(n)


def displacements(names: list[bytes | None]) -> tuple[int, np.ndarray]:
    """(seed, displacement per bucket) under which the distinct names fall on 0 .. len(names) - 1, each on its own slot.

    A negative displacement -1 - s names slot s. Work is linear in the number of names on average.
    """
    n, buckets = len(names), max(1, len(names) // KEYS_PER_BUCKET)
    for seed in range(64):
        h = _hashes(names, seed)
        bucket = (h[:, 0] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        sizes = np.diff(starts)
        second, taken, out = h[order, 1].tolist(), bytearray(n), np.zeros(buckets, np.int32)
        largest_first = np.argsort(-sizes, kind="stable")
        single = []
        for b in largest_first.tolist():
            members = second[starts[b] : starts[b + 1]]
            if len(members) < 2:
                single = [x for x in largest_first.tolist() if sizes[x] == 1]
                break
            if len(set(members)) < len(members):
                break  # two keys with one hash: another seed
            d = 0
            while True:
                places = [_slot(m, d, n) for m in members]
                if not any(taken[p] for p in places) and len(set(places)) == len(places):
                    break
                d += 1
            for p in places:
                taken[p] = 1
            out[b] = d
        if sizes.max(initial=0) < 2:
            single = np.flatnonzero(sizes == 1).tolist()
        free = [i for i, t in enumerate(taken) if not t]
        if len(free) == len(single):
            out[single] = -1 - np.array(free, np.int64)
            return seed, out
    raise ValueError("no displacements found")


# --- shard files ------------------------------------------------------------------------------------------------------------


def pack_shard(names: list[bytes | None], ids: list[bytes], width: int) -> bytes:
    """The file of documents in order; equal names stand next to each other."""
    firsts = [i for i, n in enumerate(names) if i == 0 or n != names[i - 1]]
    keys = [names[i] for i in firsts]
    runs = np.diff(np.array([*firsts, len(names)], np.uint32))
    seed, displaced = displacements(keys)
    h = _hashes(keys, seed)
    at = _located(h, displaced, len(keys))
    slots = np.zeros((len(keys), 3), "<u4")
    slots[at] = np.stack([_fingerprint(h), np.array(firsts, np.uint32), runs.astype(np.uint32)], axis=1)
    offsets = np.zeros(len(ids) + 1, "<u8")
    np.cumsum([len(i) // width for i in ids], out=offsets[1:])
    lengths = np.array([_NULL if k is None else len(k) for k in keys], "<u4")
    text = b"".join(k for k in keys if k is not None)
    header = _HEADER.pack(MAGIC, width, len(ids), len(keys), len(displaced), seed, len(text), int(offsets[-1]))
    return b"".join([header, displaced.astype("<i4").tobytes(), slots.tobytes(), offsets.tobytes(), lengths.tobytes(), text, *ids])


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (h[:, 0] >> np.uint64(32)).astype(np.uint32)


def _located(h: np.ndarray, displaced: np.ndarray, n: int) -> np.ndarray:
    d = displaced[(h[:, 0] % np.uint64(len(displaced))).astype(np.int64)].astype(np.int64)
    return np.where(d < 0, -1 - d, _slots(h[:, 1], np.maximum(d, 0), n).astype(np.int64))


class Shard:
    """Keyed access to one shard file."""

    def __init__(self, data: bytes):
        magic, self.width, self.n_docs, self.n_keys, buckets, self._seed, text, self.n_ids = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard of ids")
        at = _HEADER.size

        def array(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self._displaced, self._slots = array("<i4", buckets), array("<u4", 3 * self.n_keys).reshape(-1, 3)
        self.offsets, self._lengths = array("<u8", self.n_docs + 1).astype(np.int64), array("<u4", self.n_keys)
        self._text, self._payload, self._data = at, at + text, data
        if len(data) < self._payload + self.n_ids * self.width:
            raise ValueError("a shard of ids is cut off")

    def names(self) -> list[bytes | None]:
        """The distinct keys in order."""
        out, at = [], self._text
        for n in self._lengths.tolist():
            out.append(None if n == _NULL else self._data[at : at + n])
            at += 0 if n == _NULL else n
        return out

    def find(self, names: list[bytes | None]) -> np.ndarray:
        """(first document, documents) of every name; (0, 0) for a name whose fingerprint is not there."""
        if not names:
            return np.zeros((0, 2), np.int64)
        h = _hashes(names, self._seed)
        slot = self._slots[_located(h, self._displaced, self.n_keys)]
        return np.where((slot[:, 0] == _fingerprint(h))[:, None], slot[:, 1:], 0).astype(np.int64)

    def ids(self, document: int) -> np.ndarray:
        """The ids of the n-th document."""
        a, b = self.offsets[document : document + 2].tolist()
        return np.frombuffer(self._data, f"<u{self.width}", b - a, self._payload + a * self.width).astype("<u4")


def write_shards(docs: DataFrame, path: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS) -> None:
    """Write the ids of all documents, in ascending order of id, as shards below ``path``, and their ``manifest``.

    Each text is encoded whole by the tokenizers library without special tokens and gets the id ``end``. Null text is empty (one id).
    Null ids come first; documents of one id follow each other in the order of their texts' hashes, and may go on in the next shard. Ids are
    integers or strings. Rows are dealt by ranges of the id, then by hash and row, so a repeated id is spread too. A shard
    is closed beyond ``shard_ids`` ids or ``shard_docs`` documents and holds at least one document, so only one longer document
    makes a longer shard. An empty table writes an empty manifest. Other columns are not read.
    """
    spark = docs.sparkSession

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(tokenizer, end)
        task, made = TaskContext.get().partitionId(), 0
        names: list[bytes | None] = []
        ids: list[bytes] = []
        held = 0

        def shard() -> pd.DataFrame:
            return pd.DataFrame({"content": [pack_shard(names, ids, own.type.itemsize)], "shard": [(task << 24) + made]})

        for batch in batches:
            for name, coded in zip(batch["name"], own.batch(list(batch["text"]))):
                if ids and (held + len(coded) > shard_ids * own.type.itemsize or len(ids) >= shard_docs):
                    yield shard()
                    names, ids, held, made = [], [], 0, made + 1
                names.append(None if name is None else name.encode("utf-8", "surrogatepass"))
                ids.append(coded)
                held += len(coded)
        if ids:
            yield shard()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    order = [F.asc_nulls_first("id"), F.asc("h"), F.asc("row")]
    rows = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(shuffle_partitions(docs), *order).sortWithinPartitions(*order)
    built = rows.select(F.col("id").cast("string").alias("name"), "text").mapInPandas(build, "content binary, shard long")
    lines = built.select(F.col("content").cast("string").alias("value"), "shard")
    lines.write.partitionBy("shard").option("lineSep", "\n").option("compression", "none").text(f"{path}/shards")
    kind = docs.schema[id_col].dataType.simpleString()
    empty = f"shard long, first {kind}, last {kind}, n_docs long, n_ids long, before long"
    if spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/shards").select("path").isEmpty():
        spark.createDataFrame([], empty).write.parquet(f"{path}/manifest")
        return
    ends = _contents(spark, path).mapInPandas(_ends, "shard long, first string, last string, n_docs long, n_ids long")
    ends = ends.select("shard", F.col("first").cast(kind).alias("first"), F.col("last").cast(kind).alias("last"), "n_docs", "n_ids")
    running_before(cut_lineage(ends), [], ["shard"], "n_ids").select("shard", "first", "last", "n_docs", "n_ids", F.col("before").cast("long")).write.parquet(f"{path}/manifest")


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary, shard long").load(f"{path}/shards").select("shard", "content")


def _text(name: bytes | None) -> str | None:
    return None if name is None else name.decode("utf-8", "surrogatepass")


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for number, data in zip(batch["shard"], batch["content"]):
            s = Shard(data)
            names = s.names()
            rows.append((number, _text(names[0]), _text(names[-1]), s.n_docs, s.n_ids))
        yield pd.DataFrame(rows, columns=["shard", "first", "last", "n_docs", "n_ids"])


def _digests(number: int, s: Shard, names: list[bytes | None]) -> pd.DataFrame:
    """Every document of the names, found by the index and read from the payload."""
    found = s.find(names)
    places = np.repeat(found[:, 0] - np.cumsum(found[:, 1]) + found[:, 1], found[:, 1]) + np.arange(found[:, 1].sum())
    crc = [zlib.crc32(s.ids(p).tobytes()) for p in places.tolist()]
    keys = [_text(n) for n, k in zip(names, found[:, 1].tolist()) for _ in range(k)]
    return pd.DataFrame({"name": pd.Series(keys, dtype=object), "shard": number, "nth": places, "start": s.offsets[places], "n_tokens": np.diff(s.offsets)[places], "ids_crc32": pd.Series(crc, dtype="int64")})


_DIGESTS = "name string, shard long, nth long, start long, n_tokens long, ids_crc32 long"


def read_back(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the shards below ``path``: start counts the ids of all documents before it.

    Each shard is read by itself and every key goes through its index; nothing is shuffled.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, data in zip(batch["shard"], batch["content"]):
                s = Shard(data)
                yield _digests(number, s, s.names())

    manifest = spark.read.parquet(f"{path}/manifest")
    if manifest.isEmpty():
        return _placed(spark.createDataFrame([], _DIGESTS), manifest, id_col)
    return _placed(_contents(spark, path).mapInPandas(read, _DIGESTS), manifest, id_col)


def _placed(found: DataFrame, manifest: DataFrame, id_col: str) -> DataFrame:
    name = F.col("name").cast(manifest.schema["first"].dataType).alias(id_col)
    return found.join(manifest.select("shard", "before"), "shard").select(name, (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def lookup_keys(spark: SparkSession, path: str, keys: DataFrame, id_col: str = "doc_id", routes: int = ROUTES) -> DataFrame:
    """The rows of ``read_back`` for the ids in ``keys`` (repeats count once; ids that are not there find nothing).

    A key goes to the shards whose first and last key enclose it; only those are read. The manifest is passed to the tasks in
    blocks of ``routes`` shards.
    """
    manifest = spark.read.parquet(f"{path}/manifest").orderBy("shard")
    rows = keys.select(F.col(id_col).alias("id")).distinct()
    n, asked = manifest.count(), None
    numbered = cut_lineage(manifest.select("shard", "first", "last").withColumn("nth", F.row_number().over(Window.orderBy("shard")) - 1)) if n else None
    for block in range(-(-n // routes)):
        ends = numbered.where(F.floor(F.col("nth") / routes) == block).orderBy("shard").collect()
        part = rows.select("id", _route(ends)(F.col("id")).alias("shards")).select("id", F.explode("shards").alias("shard"))
        asked = part if asked is None else asked.unionByName(part)
    if asked is None:
        return _placed(spark.createDataFrame([], _DIGESTS), manifest, id_col)
    wanted = asked.groupBy("shard").agg(F.collect_list(F.struct(F.col("id").cast("string").alias("name"))).alias("names"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, names, data in zip(batch["shard"], batch["names"], batch["content"]):
                yield _digests(number, Shard(data), [None if n["name"] is None else n["name"].encode("utf-8", "surrogatepass") for n in names])

    return _placed(wanted.join(_contents(spark, path), "shard").mapInPandas(read, _DIGESTS), manifest, id_col)


def _route(ends: list):
    """The shards of a block that may hold an id; null sorts first."""
    order = lambda v: (v is not None, 0 if v is None else v)
    shards, firsts, lasts = [r.shard for r in ends], [order(r.first) for r in ends], [order(r.last) for r in ends]

    @F.pandas_udf("array<long>")
    def of(ids: pd.Series) -> pd.Series:
        keys = [order(None if pd.isna(v) else v) for v in ids]
        return pd.Series([shards[bisect.bisect_left(lasts, k) : bisect.bisect_right(firsts, k)] for k in keys])

    return of
