"""Passages of held-out items in a corpus.

An item is split into one piece more than the number of errors allowed, all pieces of at most half a passage: whatever
the errors, some piece stands unharmed in a text that gives the item away, and a passage of ``run`` words always holds
a whole piece. Exact piece hits are found in one pass over each text. Around each hit Myers' bit-parallel edit distance
over words decides: between the text and each passage of ``run`` words of the item that the piece lies in (a leaked
passage has distance 0), and between the text and the whole item (leaked within its error budget).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.session import written

RUN = 12
#: The items' size up to which their pieces go to every worker; beyond it pieces and texts meet in a shuffle.
BROADCAST_CHARS = 16_000_000


def word_line(text: Column) -> Column:
    """The words (runs of ``a-z0-9`` after lowercasing) with one space before, between and after; NULL has none."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), "[^a-z0-9]+", " ")


def pieces_of(words: list[str], run: int = RUN) -> list[tuple[int, int]]:
    """(start, stop) of pieces of about equal length, at most ``run // 2`` words."""
    n = len(words)
    count = -(-n // (run // 2))
    return [(n * k // count, n * (k + 1) // count) for k in range(count)]


def myers(pattern: list[str], text: list[str]) -> int:
    """The least edit distance in words between ``pattern`` and any part of ``text`` (bit-parallel)."""
    m = len(pattern)
    if not m:
        return 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = defaultdict(int)
    for k, w in enumerate(pattern):
        peq[w] |= 1 << k
    pv, mv, score, best = full, 0, m, m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        best = min(best, score)
    return best


def verify(words: list[str], item: list[str], hits: set[tuple[int, int]], budget: int, run: int = RUN) -> tuple[int | None, int, int]:
    """Around ``hits`` (place in the text, place in the item): the least distance of a passage of ``run`` words of the item
    (None if it has none), the longest run of equal words, and the least distance of the whole item."""
    longest, distance, passage = 0, len(item), None if len(item) < run else run
    for begin in {at - k for at, k in hits}:
        # runs of equal words on the hit's diagonal, and the passages that a hit lies in
        near = sorted(k for at, k in hits if at - k == begin)
        for k in near:
            lo, hi = k, k
            while lo > 0 and begin + lo > 0 and words[begin + lo - 1] == item[lo - 1]:
                lo -= 1
            while hi < len(item) and begin + hi < len(words) and words[begin + hi] == item[hi]:
                hi += 1
            longest = max(longest, hi - lo)
            for w in range(max(0, k - run + 1), min(k, len(item) - run) + 1):
                if not passage:
                    break
                passage = min(passage, myers(item[w : w + run], words[max(0, begin + w) : max(0, begin + w + run)]))
        distance = min(distance, myers(item, words[max(0, begin - budget) : max(0, begin + len(item) + budget)]))
    return passage, longest, distance


OUT = "doc_id long, item_id long, passage_distance int, longest_run int, edit_distance int, item_words int, error_budget int"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((c, pa.int32()) for c in ("passage_distance", "longest_run", "edit_distance", "item_words", "error_budget"))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)


def _report(doc: int, item_id: int, words: list[str], item: list[str], hits: set[tuple[int, int]], run: int) -> tuple:
    budget = len(pieces_of(item, run)) - 1
    passage, longest, distance = verify(words, item, hits, budget, run)
    return doc, item_id, passage, longest, distance, len(item), budget


def _scan(shared, run: int):
    """One pass of all pieces over each text; ``shared`` holds the items' lines for all tasks."""
    state: dict = {}

    def build() -> dict:
        machine, places = ahocorasick.Automaton(), defaultdict(list)
        items = {i: line.split() for i, line in shared.value}
        for i, words in items.items():
            for a, b in pieces_of(words, run):
                places[" " + " ".join(words[a:b]) + " "].append((i, a))
        for piece, where in places.items():
            machine.add_word(piece, (len(piece), where))
        if places:
            machine.make_automaton()
        return {"machine": machine if places else None, "items": items}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state.update(build())
        machine, items = state["machine"], state["items"]
        for batch in batches:
            out = []
            for doc, line in zip(batch.column("doc_id").to_pylist(), batch.column("line").to_pylist()):
                hits: dict[int, set] = defaultdict(set)
                upto = counted = 0  # blanks are counted from one hit to the next
                for end, (length, where) in machine.iter(line) if machine else ():
                    begin = end - length + 1
                    counted += line.count(" ", upto, begin) if begin >= upto else -line.count(" ", begin, upto)
                    upto = begin
                    for i, k in where:
                        hits[i].add((counted, k))
                if hits:
                    words = line.split()
                    out += [_report(doc, i, words, items[i], h, run) for i, h in hits.items()]
            yield _batch(out)

    return scan


#: Bits of the filter for each piece, and at most; a fuller filter only lets more through to the join.
FILTER_BITS, MOST_BITS = 16, 1 << 27
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Hashes:
    """Hashes of runs of words, rolled over a text."""

    def __init__(self) -> None:
        self.held: dict[str, int] = {}
        self.power = self.back = np.ones(1, np.uint64)

    def words(self, words: list[str]) -> np.ndarray:
        held = self.held
        if len(held) > 1_000_000:
            held.clear()
        for w in words:
            if w not in held:
                held[w] = xxhash.xxh64_intdigest(w)
        n = len(words) + 1
        while len(self.power) < n:
            self.power, self.back = (np.cumprod(np.full(2 * n, b, np.uint64), dtype=np.uint64) for b in (_BASE, _BACK))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.array([held[w] for w in words], np.uint64) * self.power[: n - 1])])

    def runs(self, sums: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all runs of ``n`` words."""
        if len(sums) <= n:
            return np.zeros(0, np.uint64)
        h = (sums[n:] - sums[:-n]) * self.back[: len(sums) - n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9) + np.uint64(2 * n)
        return h ^ (h >> np.uint64(29))


def _bits_of(h: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([h % np.uint64(bits), (h >> np.uint64(20)) * np.uint64(0x94D049BB133111EB) % np.uint64(bits)]).astype(np.int64)


def _joined(docs: DataFrame, items: DataFrame, run: int) -> DataFrame:
    """The same for items too many to be sent to every worker. Runs of words of the lengths that pieces have are hashed in
    each text and sifted by a filter of the pieces; only what passes is shuffled to the pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, line in zip(batch.column("item_id").to_pylist(), batch.column("line").to_pylist()):
                w = line.split()
                for a, b in pieces_of(w, run):
                    for column, value in zip(out, (i, a, b - a, int(hashes.runs(hashes.words(w[a:b]), b - a)[0]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(np.array(out[3], np.uint64).view(np.int64))], names=["item_id", "k", "n", "h"])

    pieces = written(items.mapInArrow(cut, "item_id long, k int, n int, h long"), "pieces")
    lengths = sorted(r["n"] for r in pieces.select("n").distinct().collect())  # at most half a passage
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (FILTER_BITS * pieces.count()).bit_length()))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits, bool)
        for batch in batches:
            held[_bits_of(batch.column("h").to_numpy().view(np.uint64), bits).ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(held).tobytes()], pa.binary())], names=["bits"])

    spark = docs.sparkSession
    sieve = np.zeros(bits // 8, np.uint8)
    for r in pieces.select("h").coalesce(16).mapInArrow(part, "bits binary").toLocalIterator():  # of fixed size
        sieve |= np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(sieve)

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = _Hashes(), np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            rows: list[tuple] = []
            for doc, line in zip(batch.column("doc_id").to_pylist(), batch.column("line").to_pylist()):
                sums = hashes.words(line.split())
                for n in lengths:
                    h = hashes.runs(sums, n)
                    at = np.flatnonzero(held[_bits_of(h, bits)].all(axis=0))
                    if len(at):
                        rows.append((np.full(len(at), doc), np.full(len(at), n), at, h[at].view(np.int64)))
            cols = [np.concatenate(c) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int32)), pa.array(cols[3], pa.int64())], names=["doc_id", "n", "at", "h"])

    hits = docs.mapInArrow(roll, "doc_id long, n int, at int, h long").join(pieces, ["n", "h"]).select("doc_id", "item_id", "at", "k").distinct()
    # hits of one document on one item; a text holds a piece at most as often as it has words
    per = hits.groupBy("doc_id", "item_id").agg(F.collect_list(F.struct("at", "k")).alias("hits"))
    both = per.join(docs, "doc_id").join(items.withColumnRenamed("line", "item"), "item_id").select("doc_id", "item_id", "line", "item", "hits")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                w, item = r["line"].split(), r["item"].split()
                ends = dict(pieces_of(item, run))
                # a hash may be another run's
                held = {(h["at"], h["k"]) for h in r["hits"] if w[h["at"] : h["at"] + ends[h["k"]] - h["k"]] == item[h["k"] : ends[h["k"]]]}
                if held:
                    out.append(_report(r["doc_id"], r["item_id"], w, item, held, run))
            yield _batch(out)

    return both.mapInArrow(check, OUT)


def leaks(docs: DataFrame, items: DataFrame, run: int = RUN, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(doc_id, item_id, passage_distance, longest_run, edit_distance, item_words, error_budget) for each document and item
    that have a piece in common. ``docs`` is (doc_id, text), ``items`` (item_id, text), both ids unique.

    ``passage_distance`` is 0 exactly if the document holds a passage of ``run`` words of the item, and NULL for items of fewer
    words. ``longest_run`` is the longest run of equal consecutive words if it is at least ``run`` words, and a lower bound
    below. ``edit_distance`` is in words and exact for a document that holds the whole item with at most
    ``error_budget`` errors. NULL and empty texts leak nothing and give nothing away; NULL ids stay out; other columns
    are ignored.
    """
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), word_line(F.col("text")).alias("line")).where("line <> ' '")
    items = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), word_line(F.col("text")).alias("line")).where("line <> ' '")
    chars = items.agg(F.sum(F.length("line"))).first()[0] or 0
    if chars <= broadcast_chars:
        shared = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["line"]) for r in items.toLocalIterator()])
        return docs.mapInArrow(_scan(shared, run), OUT)
    return _joined(docs, items, run)
