"""SimHash near duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most two bits differ in at most one bit of one half. Each half is therefore
indexed under 32 variants with one bit left out; equal variants meet in an equality join and the distance is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import LOWER, UPPER, fresh, lookup
from firmlens.llm.components import components
from firmlens.session import cut_lineage

SHINGLE, MAX_BITS, SEED = 3, 2, 42
DENSE = 1024
CHUNK = 1 << 16
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _counts(shingles: list[bytes], seed: int) -> np.ndarray:
    """How many of the shingles' hashes have each of the 64 bits set."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, len(shingles))
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint; words are cut a block of bytes at a time, so a long text needs little memory."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    bits, total, carry, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK * 16)
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        words = carry + data[at:end].split()
        at = end
        parts = [b" ".join(w) for w in zip(*(words[i:] for i in range(shingle)))]
        if parts:
            bits += _counts(parts, seed)
            total += len(parts)
        carry = words[-(shingle - 1) :] if shingle > 1 else []
    if not total and carry:
        bits, total = _counts([b" ".join(carry)], seed), 1
    return int(np.packbits(2 * bits > total, bitorder="little").view(np.int64)[0]) if total else 0


def fingerprints(docs: DataFrame, text_col: str, out: str, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle, seed) for t in texts], dtype="int64")

    return docs.withColumn(out, of(F.col(text_col)))


def _near(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


def links(nodes: DataFrame, dense: int = DENSE) -> DataFrame:
    """All pairs (u, v), u < v, of distinct fingerprints ``fp`` at distance 1 or 2; a pair may come twice.

    Variants shared by few fingerprints are joined pair by pair. A variant shared by more than ``dense`` would cost the
    square of its size, so each of its fingerprints emits the masks with two bits left out that can still match (two of the 33
    bits that the variant leaves open): such a mask is shared by four fingerprints at most. Both ways are exact.
    """
    half = F.col("variant").bitwiseAND(F.lit(32))
    bit = F.col("variant").bitwiseAND(F.lit(31))
    low = F.when(half == 0, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    mask = F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    keyed = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("variant"))
    keyed = keyed.select("fp", F.call_function("shiftleft", F.col("variant").cast("long"), F.lit(32)).bitwiseOR(low.bitwiseAND(mask)).alias("key"))
    # the fingerprints of a variant have one of two values in its half, so without a half that more than dense / 2 share no
    # variant is large and a window gathers little; halves are counted before the shuffle, two rows a fingerprint
    halves = nodes.select(F.explode(F.array(F.struct(F.lit(0).alias("i"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("v")), F.struct(F.lit(1).alias("i"), F.shiftrightunsigned("fp", 32).alias("v")))).alias("h"))
    if halves.groupBy("h.i", "h.v").count().where(F.col("count") > dense // 2).isEmpty():
        shared = keyed.select("fp", "key", F.expr("count(1) over (partition by key)").alias("n"))
    else:
        sizes = cut_lineage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        shared = lookup(keyed.withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(256)).cast("int")), "part", ["key"], sizes)
    shared = cut_lineage(shared.select("fp", "key", "n").where("n > 1"))
    few = shared.where(F.col("n") <= dense)
    a, b = few.select("key", F.col("fp").alias("u")), few.select("key", F.col("fp").alias("v"))
    pairs = a.join(b, "key").where((F.col("u") < F.col("v")) & _near("u", "v")).select("u", "v")
    # position p of the open bits: 0..31 in the other half, 32 the bit left out in this half
    variant = F.shiftright("key", 32).cast("int")
    place = lambda p: F.when(F.col(p) < 32, F.col(p) + F.when(variant < 32, 32).otherwise(0)).otherwise(variant)
    many = shared.where(F.col("n") > dense).select("fp", "key", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("p"))
    many = many.select("fp", "key", "p", F.explode(F.sequence(F.col("p") + 1, F.lit(32))).alias("q"))
    one = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), place(p))
    open_bits = one("p").bitwiseOR(one("q"))
    masked = many.select("fp", open_bits.alias("open"), F.col("fp").bitwiseAND(F.bitwise_not(open_bits)).alias("rest"))
    stars = masked.groupBy("open", "rest").agg(F.min("fp").alias("u"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return pairs.union(stars.select("u", F.explode("all").alias("v")).where("u <> v"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, dense: int = DENSE) -> DataFrame:
    """One row per input row: (id, fingerprint, component_id).

    Texts lower-case A-Z; words are runs of anything but ASCII white space; fewer words than a shingle make one shingle, none
    makes fingerprint zero (null text likewise). Fingerprints link at two or fewer differing bits; component_id is
    the smallest id reachable. Copies share a fingerprint and are one node, so they never make pairs. Null ids count only if
    a component has no other. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.pmod(F.spark_partition_id(), F.lit(1 << 20)).alias("part"))
    rows = cut_lineage(fingerprints(rows, "text", "fp", shingle, seed).select("id", "fp", "part"))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("least")))
    groups = components(links(nodes, dense)).select(F.col("u").alias("fp"), "root")
    member = nodes.join(groups, "fp")
    names = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut_lineage(lookup(member.withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(256)).cast("int")), "part", ["root"], names).select("fp", "component_id"))
    alone = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return lookup(rows, "part", ["fp"], alone).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, dense: int = DENSE) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns kept.

    Rows are told apart by id and text: rows that repeat both are one document and leave one row, and an id with several texts is
    judged text by text. Rows with a null id cannot name a component; one of them stays beside the named one.
    """
    (key,) = fresh(docs, "component_key")
    text = F.col(text_col)
    name = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    mark = F.concat_ws(":", F.xxhash64(text, F.octet_length(text)).cast("string"), F.octet_length(text).cast("string"), name)
    rows = fingerprints(docs.select(F.col(id_col).alias("id"), text.alias("text"), mark.alias("mark")), "text", "fp", shingle, seed)
    best = F.min(F.struct("id", "mark"))
    nodes = cut_lineage(rows.groupBy("fp", F.col("id").isNull().alias("nameless")).agg(best.alias("best")))
    groups = components(links(nodes.select("fp").distinct(), dense)).select(F.col("u").alias("fp"), "root")
    rooted = nodes.join(groups, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "nameless", "best")
    stay = rooted.groupBy("root", "nameless").agg(F.min("best").alias("best")).select(F.col("best.mark").alias(key))
    return docs.withColumn(key, mark).join(stay, key, "left_semi").dropDuplicates([key]).drop(key)
