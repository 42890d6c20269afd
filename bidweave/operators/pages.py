"""Pages: splitting, pairing renderings, packing into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidweave.functions import constants as K
from bidweave.functions.text import empty, strip


def split_pages(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each page of texts with form feeds: (all other columns, page from 1, text). A blank part behind the last
    form feed is no page."""
    parts = F.split(empty(F.col(text)), "\f")
    kept = F.when(F.trim(F.element_at(parts, -1)).rlike(r"\S"), parts).otherwise(F.slice(parts, 1, F.size(parts) - 1))
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(kept).alias("__at", text)).select(*others, (F.col("__at") + 1).alias("page"), text)


def pair_renderings(layout: DataFrame, reading: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages (key, page, text) with the same page of the second rendering as ``reading``; where a document's renderings
    have different numbers of pages, all its readings are empty."""
    counts = reading.groupBy(key).agg(F.count("*").alias("__there"))
    own = layout.withColumn("__here", F.count("*").over(Window.partitionBy(key)))
    second = reading.select(key, "page", F.col("text").alias("reading"))
    both = own.join(counts, key, "left").join(second, [key, "page"], "left")
    return both.withColumn("reading", F.when(F.col("__here") == F.col("__there"), empty(F.col("reading"))).otherwise("")).drop("__here", "__there")


def searchable(text: Column, reading: Column) -> Column:
    """Both renderings with a break between that no quote crosses."""
    return F.when(empty(reading) == "", empty(text)).otherwise(F.concat(empty(text), F.lit(K.RENDERING_BREAK), reading))


def blank_pages(pages: DataFrame, key: str = "doc_id", least: int = K.BLANK_CHARS) -> DataFrame:
    """(key, blank ARRAY of page numbers) for documents with pages of fewer than ``least`` characters."""
    blank = pages.where(F.length(strip(empty(F.col("text")))) < least)
    return blank.groupBy(key).agg(F.array_sort(F.collect_set("page")).alias("blank"))


def _next(state: Column, page: Column, limit: int) -> Column:
    """The packing after one more page: a chunk is closed before a page that would pass the limit."""
    size = state["size"] + page["block"]
    full = (F.size(state["open"]) > 0) & (size > limit)
    return F.when(full, F.struct(
        F.concat(state["done"], F.array(state["open"])).alias("done"), F.array(page["page"]).alias("open"), page["block"].alias("size"))).otherwise(
        F.struct(state["done"].alias("done"), F.concat(state["open"], F.array(page["page"])).alias("open"), size.alias("size")))


def pack_pages(pages: DataFrame, key: str = "doc_id", limit: int = K.CHUNK_CHARS) -> DataFrame:
    """(key, chunk_idx, pages): each document's pages packed greedily in order. A page counts with its length and
    20 characters; blank pages are left out; a page beyond the limit stands alone.

    Only page numbers and lengths are gathered for a document, never its text, and folded by a built-in aggregate.
    """
    sized = pages.select(key, "page", F.length(strip(empty(F.col("text")))).alias("n")).where("n > 0")
    listed = sized.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", (F.col("n") + K.CHUNK_OVERHEAD).alias("block")))).alias("all"))
    start = F.struct(F.array().cast("array<array<int>>").alias("done"), F.array().cast("array<int>").alias("open"), F.lit(0).alias("size"))
    packed = F.aggregate("all", start, lambda s, p: _next(s, p, limit), lambda s: F.concat(s["done"], F.filter(F.array(s["open"]), lambda x: F.size(x) > 0)))
    return listed.select(key, F.posexplode(packed).alias("chunk_idx", "pages"))


def chunk_texts(pages: DataFrame, key: str = "doc_id", limit: int = K.CHUNK_CHARS) -> DataFrame:
    """(key, chunk_idx, pages, text): chunks with their pages' texts behind page markers."""
    packed = pack_pages(pages, key, limit)
    each = packed.select(key, "chunk_idx", "pages", F.explode("pages").alias("page"))
    block = F.concat(F.format_string(K.PAGE_MARKER + "\n", "page"), strip(empty(F.col("text"))))
    joined = each.join(pages.select(key, "page", "text"), [key, "page"])
    # a chunk has at most the limit's worth of text, or one page
    listed = joined.groupBy(key, "chunk_idx").agg(F.first("pages").alias("pages"), F.array_sort(F.collect_list(F.struct("page", block.alias("block")))).alias("blocks"))
    return listed.select(key, "chunk_idx", "pages", F.array_join("blocks.block", "\n\n").alias("text"))
