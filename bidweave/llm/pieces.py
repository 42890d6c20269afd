"""Cutting oversized texts at natural boundaries, range by range.

A text (a cell of a table, or a file of any size) is read as ranges with halos. A worker that holds a range looks for
the best natural boundary in the window before each multiple of ``stride`` that falls into the range; its halo
reaches back over the whole window. So every cut is found on its own, no worker needs more than its range, and the
cuts of all ranges, put in order, are the boundary table of the text. Prefix sums of the ranges' lengths give each
range its offset in characters, and pieces are emitted by offset from the ranges they touch.

With windows of ``width`` before multiples of ``stride`` two consecutive cuts are at most ``stride + width`` apart;
``stride + width + overlap <= limit`` therefore bounds every piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidweave.session import written

LIMIT = 9_000
OVERLAP = 300
RANGE = 32_768
#: White space at both ends of a text, as Unicode sees it.
ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: Places where a text breaks, best first; a cut falls at the end of the match.
BREAKS = [re.compile(p) for p in (
    r"(?=<<<PAGE \d+>>>)",
    r"\n[ \t]*\n\s*",
    r"[.!?;:…。！？][\"'”’)\]]*\s+",
    r"\n",
    r"\s+",
)]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, ENDS, "")


def layout(limit: int, overlap: int) -> tuple[int, int]:
    """Stride and window width for pieces of at most ``limit`` characters."""
    if not 0 <= overlap < limit / 4:
        raise ValueError("the overlap must be less than a quarter of the limit")
    room = limit - overlap
    width = room // 4
    return room - width, width


def best_cut(text: str, lo: int, hi: int) -> tuple[int, int]:
    """The cut in ``(lo, hi]`` at the best kind of boundary, the last one of its kind, and the kind (5: none)."""
    for kind, pattern in enumerate(BREAKS):
        found = 0
        for m in pattern.finditer(text, lo, min(hi + 1, len(text))):
            if lo < m.end() <= hi:
                found = m.end()
        if found:
            return found, kind
    at = hi
    while at > lo + 1 and at < len(text) and 0x300 <= ord(text[at]) < 0x370:
        at -= 1  # an accent stays with its letter
    return at, len(BREAKS)


def _cell_ranges(size: int, back: int):
    """Rows (kind, id, text) -> ranges with halos; one text at a time is sliced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, ident, text in zip(*(batch.column(c).to_pylist() for c in ("kind", "id", "text"))):
                rows = []
                for no, at in enumerate(range(0, max(len(text), 1), size)):
                    halo = text[max(0, at - back) : at]
                    rows.append({"kind": kind, "id": ident, "no": no, "halo": halo, "body": text[at : at + size], "next": text[at + size : at + size + 8]})
                    if len(rows) == 64:
                        yield pa.RecordBatch.from_pylist(rows, schema=RANGES)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=RANGES)

    return run


RANGES = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("no", pa.int32()), ("halo", pa.string()), ("body", pa.string()), ("next", pa.string())])
RANGES_DDL = "kind string, id long, no int, halo string, body string, next string"


def cell_ranges(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """Ranges of the oversized ones among the texts of ``df`` (kind STRING, id LONG, text STRING): those of more than
    ``limit`` characters once white space at both ends is gone."""
    _, width = layout(limit, overlap)
    long = (
        df.where(F.col("id").isNotNull() & (F.length("text") > limit)).select("kind", F.col("id").cast("long").alias("id"), strip(F.col("text")).alias("text"))
        .where(F.length("text") > limit)
    )
    # written: lengths, cuts and pieces all read the ranges, and no text is sliced twice
    return written(long.dropDuplicates(["kind", "id"]).mapInArrow(_cell_ranges(max(size, width), width + 8), RANGES_DDL), "ranges")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(id, path, bytes) of the files in a folder, as Spark lists them; no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.xxhash64("path").alias("id"), "path", F.col("length").alias("bytes"))


def file_ranges(files: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, size: int = 1 << 20) -> DataFrame:
    """Ranges of UTF-8 text files (id, path, bytes) on any file system that all workers reach.

    A worker seeks to its byte range and reads it with the halos; a character belongs to the range in which its first
    byte lies. No file is read as a whole by anyone. Bytes that aren't UTF-8 become replacement characters.
    """
    _, width = layout(limit, overlap)
    back = 4 * (width + 8)
    spans = files.select("id", "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(size).cast("long"))).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, path = fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", r["path"]))
                lo = max(0, r["at"] - back)
                with system.open_input_file(path) as f:
                    data = f.read_at(r["at"] - lo + size + 64, lo)
                first, last = _char_start(data, r["at"] - lo), _char_start(data, r["at"] - lo + size)
                begin = _char_start(data, 0) if lo else 0
                text = [b.decode("utf-8", "replace") for b in (data[begin:first], data[first:last], data[last:])]
                yield pa.RecordBatch.from_pylist(
                    [{"kind": "file", "id": r["id"], "no": r["at"] // size, "halo": text[0], "body": text[1], "next": text[2][:8]}], schema=RANGES)

    tasks = files.sparkSession.sparkContext.defaultParallelism * 2
    return spans.repartition(tasks, "id", "at").mapInArrow(run, RANGES_DDL)


def _char_start(data: bytes, at: int) -> int:
    """The first byte at or after ``at`` that begins a character."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(data))


def with_offsets(ranges: DataFrame) -> DataFrame:
    """Each range with its offset and its text's length in characters: prefix sums over the table of lengths, without
    the texts."""
    own = Window.partitionBy("kind", "id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    lengths = ranges.select("kind", "id", "no", F.length("body").alias("chars"))
    return lengths.withColumn("offset", F.coalesce(F.sum("chars").over(own), F.lit(0)).cast("long")).withColumn(
        "total", F.sum("chars").over(Window.partitionBy("kind", "id")).cast("long"))


def _cuts(stride: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("kind", "id", "cut", "level")}
            for r in batch.to_pylist():
                text, at = r["halo"] + r["body"] + r["next"], r["offset"] - len(r["halo"])
                end = r["offset"] + len(r["body"])
                for target in range((r["offset"] // stride + 1) * stride, end + 1, stride):
                    if target < r["total"] and target > r["offset"]:
                        cut, level = best_cut(text, max(target - width - at, 0), target - at)
                        for k, v in zip(out, (r["kind"], r["id"], at + cut, level)):
                            out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["kind"], pa.string()), pa.array(out["id"], pa.int64()), pa.array(out["cut"], pa.int64()), pa.array(out["level"], pa.int32())], names=list(out))

    return run


def piece_offsets(ranges: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(kind, id, piece, start, stop, level): where the pieces of each text lie. ``level`` says at which kind of break a
    piece ends: 0 page, 1 paragraph, 2 sentence, 3 line, 4 word, 5 none, NULL the text's end."""
    stride, width = layout(limit, overlap)
    offsets = with_offsets(ranges)
    placed = ranges.join(offsets.select("kind", "id", "no", "offset", "total"), ["kind", "id", "no"])
    cuts = placed.mapInArrow(_cuts(stride, width), "kind string, id long, cut long, level int")
    whole = offsets.select("kind", "id", F.col("total").alias("cut"), F.lit(None).cast("int").alias("level")).distinct()
    order = Window.partitionBy("kind", "id").orderBy("cut")
    edges = cuts.unionByName(whole).select(
        "*", F.coalesce(F.lag("cut").over(order), F.lit(0)).alias("before"), F.lead("cut").over(order).alias("after"), F.lead("level").over(order).alias("then"))
    # the last cut isn't needed where the rest fits into one piece
    spare = F.col("level").isNotNull() & F.col("then").isNull() & (
        F.col("after") - F.greatest(F.col("before") - overlap, F.lit(0)) <= limit)
    kept = edges.where(~spare).select("kind", "id", "cut", "level")
    return kept.select(
        "kind", "id", (F.row_number().over(order) - 1).alias("piece"),
        F.greatest(F.coalesce(F.lag("cut").over(order), F.lit(0)) - F.when(F.lag("cut").over(order).isNotNull(), overlap).otherwise(0), F.lit(0)).alias("start"),
        F.col("cut").alias("stop"), "level")


def emit(ranges: DataFrame, pieces: DataFrame, size: int = RANGE) -> DataFrame:
    """The pieces with their text, put together from the ranges they touch (two in general, so nothing large is ever
    collected)."""
    offsets = with_offsets(ranges).select("kind", "id", "no", "offset", "chars")
    spans = pieces.join(offsets, ["kind", "id"]).where((F.col("offset") < F.col("stop")) & (F.col("offset") + F.col("chars") > F.col("start")))
    lo = F.greatest(F.col("start") - F.col("offset"), F.lit(0))
    hi = F.least(F.col("stop") - F.col("offset"), F.col("chars"))
    part = F.struct("no", F.substring(F.col("body"), (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    return (
        spans.join(ranges.select("kind", "id", "no", "body"), ["kind", "id", "no"])
        .groupBy("kind", "id", "piece", "start", "stop", "level").agg(F.array_sort(F.collect_list(part)).alias("parts"))
        .select("kind", "id", "piece", "start", "stop", "level", F.array_join("parts.part", "").alias("text"))
    )


def split_texts(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """The oversized texts of ``df`` (kind STRING, id LONG, text STRING) as pieces
    (kind, id, piece, start, stop, level, text).

    A piece has at most ``limit`` characters and, from the second on, begins with the last ``overlap`` characters of
    the one before; without these the pieces of a text are the text, white space at both ends removed. Texts within
    the limit, NULL texts and NULL ids give no rows; rows that repeat an id count once; further columns are ignored.
    """
    ranges = cell_ranges(df.select("kind", "id", "text"), limit, overlap, size)
    return emit(ranges, piece_offsets(ranges, limit, overlap), size)
