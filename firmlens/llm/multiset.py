"""Homomorphic multiset hash of a text's paragraphs, in built-in functions only.

Every paragraph (line) is hashed to a wide vector: eight 32-bit lanes that identify the whole paragraph and 64 lanes with the
signed counts of its phrases, weighted by their length. A fingerprint is the sum of the vectors modulo 2**32 per lane. It does not depend on paragraph
order, and inserting or deleting paragraphs adds or subtracts their vectors, so an edited text is fingerprinted
from what changed. The first lanes decide equality, the cosine of the others estimates likeness.

A phrase ends after a word that ends in a vowel or a punctuation mark, so an edit does not move the later cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmlens.llm.common import shuffle_partitions

MODULUS = 1 << 32
EXACT_HASHES, LIKENESS_LANES = 4, 64
PHRASE_END = r"\n|(?<=[aeiouyAEIOUY.,;:!?]) +"
BUCKETS_PER_PARTITION = 4


def exact_lanes(text: Column) -> Column:
    """The paragraph-identifying lanes: sums of 32-bit halves of four hashes of each line."""
    lines, zero = F.split(text, "\n"), F.lit(0).cast("long")
    lanes = []
    for seed in range(EXACT_HASHES):
        hashes = F.transform(lines, lambda p: F.xxhash64(p, F.lit(seed)))  # noqa: B023
        lanes.append(F.aggregate(hashes, zero, lambda a, h: (a + h.bitwiseAND(F.lit(MODULUS - 1))) % F.lit(MODULUS)))
        lanes.append(F.aggregate(hashes, zero, lambda a, h: (a + F.shiftrightunsigned(h, 32)) % F.lit(MODULUS)))
    return F.array(*lanes)


def combined(a: Column, b: Column, sign: int) -> Column:
    """Lanes of a with those of b inserted (sign 1) or deleted (-1)."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + F.lit(sign) * y, F.lit(MODULUS)))


def _signed(lane: Column) -> Column:
    return F.when(lane >= F.lit(MODULUS // 2), lane - F.lit(MODULUS)).otherwise(lane).cast("double")


def likeness(a: Column, b: Column, exact_a: Column, exact_b: Column) -> Column:
    """Cosine of the phrase lanes, 0 to 1; 1 if the fingerprints are equal, 0 if one has no phrase mass."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: _signed(p) * _signed(q)), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    cosine = F.when(norm > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / norm))).otherwise(F.lit(0.0))
    return F.when((a == b) & (exact_a == exact_b), F.lit(1.0)).otherwise(cosine)


def hexadecimal(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def phrase_sums(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Signed phrase counts per key from rows (keys, sign, part): 32 sums that hold two 32-bit lanes each."""
    rows = parts.select(*keys, "sign", F.explode(F.split("part", PHRASE_END)).alias("phrase")).withColumn("h", F.xxhash64("phrase"))
    lane = F.pmod(F.col("h"), F.lit(LIKENESS_LANES))
    sign = F.col("sign") * F.char_length("phrase") * (F.lit(1) - F.lit(2) * F.pmod(F.shiftright("h", 8), F.lit(2)))
    rows = rows.select(*keys, F.floor(lane / 2).cast("int").alias("slot"), (sign * F.when(lane % 2 == 1, F.lit(MODULUS)).otherwise(F.lit(1))).alias("value"))
    return rows.groupBy(*keys).agg(*(F.sum(F.when(F.col("slot") == k, F.col("value"))).alias(f"s{k}") for k in range(LIKENESS_LANES // 2)))


def _lanes(sums: list[Column]) -> Column:
    """The two lanes of each sum, modulo 2**32."""
    out = []
    for s in sums:
        s = F.coalesce(s, F.lit(0).cast("long"))
        low = F.pmod(s, F.lit(MODULUS))
        out += [low, F.pmod(F.shiftright(s, 32) + F.when(low >= F.lit(MODULUS // 2), 1).otherwise(0), F.lit(MODULUS))]
    return F.array(*out)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, bucket, id, text, next_text, extra): each text beside the next by ascending id, the last beside the first.

    Rows are ordered by (id, hash of the text, row), which tells all rows apart, and cut into ranges of similar size, so that an
    id that very many rows share is cut too. A range's first row is also given to the range before it (``extra``); each
    range is then finished alone and the texts are shuffled once. The driver sees the first key of each range.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    key = F.struct("id", "h", "row")
    dealt = rows.select("id", "h", "row").repartitionByRange(BUCKETS_PER_PARTITION * shuffle_partitions(docs), F.asc_nulls_first("id"), "h", "row")
    firsts = sorted((r.first for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("first")).collect()), key=lambda f: (f.id is not None, f.id if f.id is not None else 0, f.h, f.row))
    n = len(firsts)
    if not n:
        return rows.select("id", "text", F.lit(0).alias("bucket"), F.lit(0).alias("extra"), F.col("text").alias("next_text"), F.lit(0).cast("long").alias("rid")).where("false")
    id_type = docs.schema[id_col].dataType
    known = F.array(*(F.struct(F.lit(f.id).cast(id_type).alias("id"), F.lit(f.h).cast("long").alias("h"), F.lit(f.row).cast("long").alias("row")) for f in firsts))
    steps = F.array(*(F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)))
    # how many first keys are not above the row's key, by binary search
    not_above = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when((at + step <= n) & (F.get(known, at + step - 1) <= key), step).otherwise(F.lit(0)))
    placed = rows.withColumn("bucket", not_above - 1)
    before = F.when(F.get(known, F.col("bucket")) == key, F.pmod(F.col("bucket") - 1, F.lit(n)))
    targets = F.array(F.struct(F.col("bucket"), F.lit(0).alias("extra")), F.when(before.isNotNull(), F.struct(before.alias("bucket"), F.lit(1).alias("extra"))))
    own = placed.select("id", "text", "h", "row", F.explode(targets).alias("to")).where("to IS NOT NULL").select("id", "text", "h", "row", "to.bucket", "to.extra")
    order = Window.partitionBy("bucket").orderBy("extra", F.asc_nulls_first("id"), "h", "row")
    ordered = own.withColumn("next_text", F.lead("text").over(order)).withColumn("nth", F.row_number().over(order).cast("long")).drop("h", "row")
    return ordered.withColumn("rid", F.shiftleft(F.col("bucket").cast("long"), 40) + F.col("nth"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last floor(n_chars / 4) code points replaced by as many first ones of the next document by ascending
    id (all of it if it is shorter). Its fingerprint is that of the text less the paragraphs that the edit touches plus
    the new ones. Null text is empty; the empty text is one empty paragraph. Ids are numbers or strings; null ids come first,
    repeated ids in the order of their texts' hashes. One row alone is its own next. An empty table gives an empty result.
    Other columns are not read.
    """
    rows = with_next(docs, id_col, text_col)
    n, quarter = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("long"), "keep": F.col("text").substr(F.lit(1), n - quarter)})
    rows = rows.withColumn("edited", F.concat("keep", F.coalesce(F.col("next_text"), F.lit("")).substr(F.lit(1), quarter)))
    back = F.instr(F.reverse("keep"), "\n")
    same = F.when(back == 0, 0).otherwise(F.char_length("keep") - back + 1)
    rows = rows.withColumns({"gone": F.col("text").substr(same + 1, n), "come": F.col("edited").substr(same + 1, F.char_length("edited"))})
    slim = rows.select(
        "rid", "bucket", "extra", "id", "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        exact_lanes(F.col("text")).alias("exact"), exact_lanes(F.col("gone")).alias("less"), exact_lanes(F.col("come")).alias("plus"),
    )
    parts = F.array(*(F.struct(F.lit(w).alias("which"), F.lit(s).alias("sign"), F.col(c).alias("part")) for w, s, c in ((0, 1, "text"), (1, -1, "gone"), (1, 1, "come"))))
    sums = phrase_sums(rows.select("rid", F.explode(parts).alias("p")).select("rid", "p.*"), ["rid", "which"])
    slots = range(LIKENESS_LANES // 2)
    both = sums.groupBy("rid").agg(*(F.sum(F.when(F.col("which") == 0, F.col(f"s{k}"))).alias(f"t{k}") for k in slots), *(F.sum(f"s{k}").alias(f"e{k}") for k in slots))
    lanes = both.select("rid", _lanes([F.col(f"t{k}") for k in slots]).alias("like"), _lanes([F.col(f"e{k}") for k in slots]).alias("edited_like"))
    full = slim.join(lanes, "rid").withColumn("edited_exact", combined(combined(F.col("exact"), F.col("less"), -1), F.col("plus"), 1)).drop("less", "plus")
    order = Window.partitionBy("bucket").orderBy("rid")
    full = full.withColumns({"next_like": F.lead("like").over(order), "next_exact": F.lead("exact").over(order)}).where("extra = 0")
    return full.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        hexadecimal(F.concat("exact", "like")).alias("fingerprint"),
        hexadecimal(F.concat("edited_exact", "edited_like")).alias("edited_fingerprint"),
        likeness(F.col("like"), F.col("edited_like"), F.col("exact"), F.col("edited_exact")).alias("near_edited"),
        likeness(F.col("like"), F.col("next_like"), F.col("exact"), F.col("next_exact")).alias("near_next"),
    )
