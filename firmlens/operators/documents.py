"""Documents from pages, and chunks from documents.

One company-year may hold a large share of all pages, so no row holds a whole document:
texts are assembled per source file, and chunks are cut from pages by their offsets.
Character offsets count from the start of the document.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions.splitter import MARKDOWN_SEPARATORS, SEPARATORS, split_spans
from firmlens.functions.text import pieces
from firmlens.operators.scale import running_before

CHUNK_SIZE = 400
CHUNK_OVERLAP = 100
PAGE_BIN = 4_096


def files_by_key(files: DataFrame, keys: Sequence[str] = ("company_id", "year")) -> DataFrame:
    """Distinct file names of every company and year, one row each."""
    return files.select(*keys, "file_name").distinct()


def page_ledger(pages: DataFrame, key: str = "doc_key") -> DataFrame:
    """Start and end offset of each page inside its document, without the text.

    One space follows every page and a blank line every source file; both are
    counted, so offsets agree with the assembled text. Needs (key, file_no, page_no,
    source_document, text).
    """
    lengths = pages.select(key, "file_no", "page_no", "source_document", F.length("text").alias("text_length"))
    last = lengths.groupBy(key, "file_no").agg(F.max("page_no").alias("last"))
    gap = F.when(F.col("page_no") == F.col("last"), 3).otherwise(1)
    sized = lengths.join(last, [key, "file_no"]).withColumn("step", F.col("text_length") + gap).drop("last")
    placed = running_before(sized, [key], ["file_no", "page_no"], "step", "page_start")
    return placed.withColumn("page_end", F.col("page_start") + F.col("text_length"))


def _gap() -> Column:
    """What follows a page: a space, and a blank line after the last page of a file."""
    return F.when(F.col("step") > F.col("text_length") + 1, " \n\n").otherwise(" ")


def assemble(pages: DataFrame, key: str = "doc_key") -> DataFrame:
    """Text of every source file with its offset in the document, as (key, file_no, file_start, text, metadata).

    The texts of a document in file order, put together, are its whole text. Offsets
    come from the narrow ledger, so the text is moved once.
    """
    ledger = page_ledger(pages, key).drop("source_document")
    page = F.struct("page_no", "text", "source_document")
    packed = pages.groupBy(key, "file_no").agg(F.array_sort(F.collect_list(page)).alias("p"))
    starts = ledger.groupBy(key, "file_no").agg(F.min("page_start").alias("file_start"))
    return packed.join(starts, [key, "file_no"]).select(
        key,
        "file_no",
        "file_start",
        F.concat(F.array_join("p.text", " "), F.lit(" \n\n")).alias("text"),
        F.transform("p", lambda x: F.struct(x["source_document"].alias("source_document"), x["page_no"].alias("page_number"), F.length(x["text"]).alias("text_length"))).alias("metadata"),
    )


def page_chunks(pages: DataFrame, key: str = "doc_key", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """The chunks of ``fixed_chunks`` over whole documents, cut from their pages.

    A page knows its offset, so it knows which chunks it touches and emits its part
    of each; a chunk joins the parts of the few pages it spans. The number and
    the start are the document's at any document size.
    """
    step = size - overlap
    ledger = page_ledger(pages, key).select(key, "file_no", "page_no", "page_start", "text_length", "step")
    placed = pages.select(key, "file_no", "page_no", "text").join(ledger, [key, "file_no", "page_no"])
    placed = placed.select(key, F.col("page_start").alias("at"), F.concat("text", _gap()).alias("text"))
    first = F.greatest(F.floor((F.col("at") - size) / step) + 1, F.lit(0))
    last = F.floor((F.col("at") + F.length("text") - 1) / step)
    parts = placed.select(key, "at", "text", F.explode(F.sequence(first, last)).alias("i"))
    start, at = F.col("i") * step, F.col("at")
    begin = F.greatest(start - at, F.lit(0)).cast("int")
    end = F.least(start + size - at, F.length("text").cast("long")).cast("int")
    cut = parts.select(key, "i", "at", F.col("text").substr(begin + 1, end - begin).alias("text"))
    chunks = cut.groupBy(key, "i").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "text")))["text"], "").alias("text"))
    # past the first, a chunk must bring more than the overlap
    chunks = chunks.where((F.col("i") == 0) | (F.length("text") > overlap))
    return chunks.select(key, (F.col("i") + 1).cast("int").alias("sequence_number"), (F.col("i") * step).alias("start_index"), "text")


def not_done(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Documents without output yet."""
    return todo.join(done.select(*keys), list(keys), "left_anti")


def error_ledger(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """First failing check per row in ``error``; null for good rows."""
    failed = None
    for message, ok in checks.items():
        bad = ~F.coalesce(ok, F.lit(False))
        failed = F.when(bad, message) if failed is None else failed.when(bad, message)
    return rows.withColumn("error", failed)


def fixed_chunks(docs: DataFrame, key: str = "doc_id", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Overlapping windows over the whole text, numbered from 1; a text shorter than one window is one chunk.

    The text is cut once into steps and a chunk is the step and the start of the
    next ones: linear in the text, where one substring per chunk would scan from
    the beginning each time. The one-element ``transform`` binds the steps.
    """
    step = size - overlap
    ahead = -(-size // step)

    def chunk(steps: Column, i: Column) -> Column:
        text = F.left(F.array_join(F.slice(steps, i + 1, ahead), ""), F.lit(size))
        return F.struct((i + 1).alias("sequence_number"), (i * step).alias("start_index"), text.alias("text"))

    last = F.greatest(F.ceil((F.length("text") - overlap) / step) - 1, F.lit(0)).cast("int")
    cut = F.transform(F.array(pieces(F.col("text"), step)), lambda steps: F.transform(F.sequence(F.lit(0), last), lambda i: chunk(steps, i)))
    return docs.where(F.length("text") > 0).select(key, F.inline(F.get(cut, F.lit(0))))


def recursive_chunks(
    docs: DataFrame,
    key: str = "doc_id",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: Sequence[str] = SEPARATORS,
    listed: bool = False,
) -> DataFrame:
    """Separator-aware chunks with their start offsets, numbered from 1 in text order.

    The splitting rule is sequential inside one text. A worker holds the texts and
    chunks of a hundred rows at a time, however many a partition has. ``listed`` keeps one row
    per document, (key, text, chunks), for work on a document's chunks beside its text.
    """
    split = partial(split_spans, size=size, overlap=overlap, separators=list(separators))

    @F.udf("array<struct<start_index:int,text:string>>", useArrow=False)
    def chunked(text: str | None) -> list[tuple[int, str]]:
        return [(a, text[a:b]) for a, b in split(text)] if text else []

    if listed:
        return docs.select(key, "text", chunked("text").alias("chunks"))
    cut = docs.select(key, F.posexplode(chunked("text")).alias("pos", "c"))
    return cut.select(key, (F.col("pos") + 1).alias("sequence_number"), "c.start_index", "c.text")


def markdown_chunks(docs: DataFrame, key: str = "doc_id", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, listed: bool = False) -> DataFrame:
    """Recursive chunks that prefer headings, fences and rules as boundaries."""
    return recursive_chunks(docs, key, size, overlap, MARKDOWN_SEPARATORS, listed)


def chunk_pages(chunks: DataFrame, ledger: DataFrame, key: str = "doc_id", bin_size: int = PAGE_BIN) -> DataFrame:
    """(chunk, page) pairs whose ranges touch, both ends inclusive.

    Both ranges are cut into fixed bins so the join has an equality on (document, bin)
    and a long document does not compare every chunk with every page. A pair
    counts in the first bin both share.
    """
    bins = lambda a, b: F.sequence(F.floor(a / bin_size), F.floor(b / bin_size))
    chunk_end = F.col("start_index") + F.length("text")
    c = chunks.select(
        key, "sequence_number", F.col("start_index").cast("long").alias("c_start"), chunk_end.cast("long").alias("c_end")
    ).withColumn("bin", F.explode(bins(F.col("c_start"), F.col("c_end"))))
    p = ledger.select(
        key, "source_document", F.col("page_no").alias("page_number"), F.col("page_start").alias("p_start"), F.col("page_end").alias("p_end")
    ).withColumn("bin", F.explode(bins(F.col("p_start"), F.col("p_end"))))
    first_shared = F.floor(F.greatest("c_start", "p_start") / bin_size)
    return (
        c.join(p, [key, "bin"])
        .where((F.col("p_start") <= F.col("c_end")) & (F.col("p_end") >= F.col("c_start")) & (F.col("bin") == first_shared))
        .select(key, "sequence_number", "source_document", "page_number")
    )


def with_source_info(chunks: DataFrame, pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks with their pages as an ordered list (empty if none); a chunk spans few pages."""
    info = pairs.groupBy(key, "sequence_number").agg(
        F.array_sort(F.collect_list(F.struct("page_number", "source_document"))).alias("source_info")
    )
    empty = F.array().cast("array<struct<page_number:int,source_document:string>>")
    return chunks.join(info, [key, "sequence_number"], "left").withColumn("source_info", F.coalesce("source_info", empty))


def chunks_without_page(chunks: DataFrame, pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.join(pairs.select(key, "sequence_number").distinct(), [key, "sequence_number"], "left_anti")


def chunk_counts(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"))
