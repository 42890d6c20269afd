"""Finding quotes on the pages of their document.

The tiers run one after another, each only over what the one before left: the cited page, then all pages, then pairs of
neighbouring pages, then near matches, then words gathered from table cells. ``exact`` and ``spans`` are the exact tiers
alone, as joins on the document and a built-in containment test; ``locate`` takes a document's pages and quotes through
all tiers in one pass over Arrow batches, the dear tiers behind a filter on the shared vocabulary.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidweave.functions import constants as K
from bidweave.functions.text import empty, squash, strip_footer, with_nfkc
from bidweave.operators.pages import searchable
from bidweave.session import written


def features(pages: DataFrame, doc: str = "doc_id", fold: bool = True) -> DataFrame:
    """(doc, page, body, sq): what each page is searched by. ``fold`` puts texts into NFKC first."""
    body = pages.select(doc, "page", searchable(F.col("text"), F.col("reading")).alias("body"))
    body = with_nfkc(body, "body") if fold else body
    return body.withColumn("sq", squash(F.col("body")))


def spans(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, page, body, sq) of each page, its footer gone, together with the next one by number."""
    own = Window.partitionBy(doc).orderBy("page")
    following = pages.withColumn("__next", F.lead("body").over(own)).withColumn("__number", F.lead("page").over(own))
    both = following.where(F.col("__number") == F.col("page") + 1)
    body = F.concat(strip_footer(F.col("body")), F.lit("\n"), F.col("__next"))
    return both.select(doc, "page", body.alias("body")).withColumn("sq", squash(F.col("body")))


def _first(found: DataFrame, id_: str) -> DataFrame:
    """The first place of each quote: the cited page before others, then by page."""
    place = F.struct((~F.col("page").eqNullSafe(F.col("cited"))).alias("other"), F.col("page").alias("page"))
    return found.groupBy(id_).agg(F.min(place).alias("m")).select(id_, F.col("m.page").alias("found_page"))


def exact(quotes: DataFrame, pages: DataFrame, id_: str = "seq", doc: str = "doc_id") -> DataFrame:
    """(id, found_page) of quotes (id, doc, key, cited) contained in a page (doc, page, sq)."""
    hit = F.contains(F.col("sq"), F.col("key"))
    cited = quotes.join(pages, (quotes[doc] == pages[doc]) & (quotes["cited"] == pages["page"])).where(hit).select(id_, F.col("page").alias("found_page"))
    rest = quotes.join(cited.select(id_), id_, "left_anti")
    other = rest.join(pages.select(doc, "page", "sq"), doc).where(hit)
    return cited.unionByName(_first(other, id_))


def ratio_beyond(a: str, b: str, least: float, lo: int = 0, hi: int | None = None, known: dict | None = None, runs: list[int] | None = None) -> float:
    """The likeness of ``a`` and ``b[lo:hi]`` if it is more than ``least``, else some value that isn't.

    Matching blocks are looked for from the largest gap on. What is still open between blocks can't match more than its
    shorter side, so the search ends as soon as that isn't enough. A block is the longest common run, the first in ``a``, then
    in ``b``, of equals, as ``SequenceMatcher`` has it; runs are sought with the built-in search, which is much faster. ``known``
    keeps the blocks of gaps for other parts of the same ``b``; ``runs`` are the longest at each place of ``a``, anywhere in ``b``.
    """
    hi, known = len(b) if hi is None else hi, {} if known is None else known
    both = len(a) + hi - lo
    if not both:
        return 1.0
    find, most = b.find, min(len(a), hi - lo)
    matched, open_ = 0, [(-most, 0, len(a), lo, hi, most)]
    while open_:
        if 2.0 * (matched + most) / both <= least:
            return 0.0
        bound, alo, ahi, blo, bhi, cap = heapq.heappop(open_)
        most += bound
        if (block := known.get((alo, ahi, blo, bhi))) is None:
            # a run is no longer than the one that opened its gap, nor than the gap
            cap = min(cap, -bound)
            size, i, first, second = 0, alo, 0, 0
            while size < cap and i + size < ahi:
                if runs and runs[i] <= size or (j := find(a[i : i + size + 1], blo, bhi)) < 0:
                    i += 1
                    continue
                size, first, second = size + 1, i, j
                while size < cap and i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
                    size += 1
            known[alo, ahi, blo, bhi] = block = (size, first, second)
        size, first, second = block
        if size:
            matched += size
            for gap in ((alo, first, blo, second), (first + size, ahi, second + size, bhi)):
                if room := min(gap[1] - gap[0], gap[3] - gap[2]):
                    most += room
                    heapq.heappush(open_, (-room, *gap, size))
    return 2.0 * matched / both


def _runs(a: str, b: str) -> list[int]:
    """How many characters from each place of ``a`` on occur together in ``b``."""
    out, k = [], 0
    for i in range(len(a)):
        while i + k < len(a) and a[i : i + k + 1] in b:
            k += 1
        out.append(k)
        k = max(0, k - 1)
    return out


def _letters(words_: list[str]) -> np.ndarray:
    """Running counts of letters, digits and spaces over a list of words."""
    codes = np.frombuffer("".join(words_).encode(), np.uint8)
    at = np.where(codes >= 97, codes - 97, codes - 48 + 26)
    word = np.repeat(np.arange(1, len(words_) + 1), [len(w) for w in words_])
    out = np.bincount(word * 37 + at, minlength=37 * (len(words_) + 1)).reshape(-1, 37).cumsum(axis=0)
    out[:, 36] = np.arange(len(words_) + 1)
    return out


def _common(a: str, windows: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of a text and each of ``windows`` (bit-parallel, all windows in one number,
    a place that is never set between them): the likeness can't be based on more."""
    codes = np.frombuffer("\n".join(windows).encode(), np.uint8)
    number = lambda x: int.from_bytes(np.packbits(x, bitorder="little").tobytes(), "little")
    at = {c: number(codes == ord(c)) for c in set(a)}
    full = v = number(codes != 10)
    for c in a:
        u = v & at[c]
        v = (v + u | v - u) & full
    left = np.unpackbits(np.frombuffer(v.to_bytes(len(codes) // 8 + 1, "little"), np.uint8), bitorder="little")
    sizes = np.array([len(w) for w in windows])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    run = np.concatenate([[0], np.cumsum(left, dtype=np.int64)])
    return sizes - (run[starts[:-1] + sizes] - run[starts[:-1]])


class _Page:
    """A place's words, and their running counts of letters."""

    def __init__(self, page: list[str]):
        self.words, self.set, self._run = page, set(page), None
        self.text = " ".join(page)
        self.starts = np.cumsum([0, *(len(w) + 1 for w in page)])

    @property
    def run(self) -> np.ndarray:
        if self._run is None:
            self._run = _letters(self.words)
        return self._run


def window_ratio(quote: list[str], page: list[str] | _Page, floor: float = 0.0) -> float:
    """The best likeness of the quote to any run of about its length that begins with one of its first four words; 0 if
    it is less than ``floor``.

    Letters in common, then the longest common subsequence, bound the likeness from above; windows are compared from
    the best bound on, until no bound is better than what was found.
    """
    page = page if isinstance(page, _Page) else _Page(page)
    n, held_words = len(quote), page.words
    lead = set(quote[:4])
    starts = np.array([i for i, w in enumerate(held_words) if w in lead], np.int64)
    if not n or not len(starts):
        return 0.0
    sizes = np.array(sorted({max(1, int(n * 0.85)), n, int(n * 1.15) + 1}))
    begin = np.repeat(starts, len(sizes))
    end = np.minimum(begin + np.tile(sizes, len(starts)), len(held_words))
    own = _letters(quote)[-1].copy()
    own[36] -= 1
    held = page.run[end] - page.run[begin]
    held[:, 36] -= 1
    both = held.sum(axis=1) + own.sum()
    bound = 2.0 * np.minimum(held, own).sum(axis=1) / both
    target, best, known, runs = " ".join(quote), 0.0, {}, []

    def compare(k: int) -> float:
        # likeness depends on the order of its arguments: the quote is the first
        return max(best, ratio_beyond(target, page.text, max(best, floor - 1e-9), int(page.starts[begin[k]]), int(page.starts[end[k]]) - 1, known, runs))

    first = int(np.argmax(bound))
    if bound[first] < floor:
        return 0.0
    best = compare(first)
    open_ = (bound > best) & (bound >= floor)
    open_[first] = False
    if open_.any():
        # what a start's longest window has in common with the quote bounds its shorter windows too
        own_starts, which = np.unique(begin[open_], return_inverse=True)
        common = _common(target, [" ".join(held_words[i : i + int(sizes[-1])]) for i in own_starts])
        ks = np.flatnonzero(open_)
        most = np.minimum(bound[ks], 2.0 * np.minimum(common[which], both[ks] - len(target)) / both[ks])
        order = np.argsort(-most, kind="stable")
        if (most > max(best, floor)).sum() > 3:
            runs = _runs(target, page.text)
        for m in order:
            if most[m] <= best or most[m] < floor:
                break
            best = compare(int(ks[m]))
    return best if best >= floor else 0.0


def covering(needed: set[str], page: list[str]) -> int | None:
    """The length of the shortest run of page words with every needed word."""
    last: dict[str, int] = {}
    best = None
    for i, w in enumerate(page):
        if w in needed:
            last[w] = i
            if len(last) == len(needed):
                size = i - min(last.values()) + 1
                best = size if best is None or size < best else best
    return best


#: Quotes of a document that one task takes; those of a document with more are dealt to several.
CROWD = 1000
FOUND = "seq long, status string, page int, end_page int, ratio double, size int, run int"
_NOT_WORD = re.compile("[^a-z0-9]+")
#: Java's patterns see only ASCII white space there, and its end stands before a last line break of any kind too.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_FURNITURE = re.compile(rf"(?ai)^(?:[^\S\n]*|{K.FOOTER})(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)")


def _trimmed(body: str) -> str:
    """``strip_footer`` of one text."""
    lines = re.sub(rf"[{_SPACE}]+\Z", "", body).split("\n")
    while lines and _FURNITURE.search(lines[-1]):
        lines.pop()
    return "\n".join(lines)


class _Document:
    """The pages of a document (page, body), by number, and what quotes are sought in, made when it is first asked for."""

    def __init__(self, pages: list[tuple[int | None, str]]):
        self.pages = pages
        self.exact = [(page, _NOT_WORD.sub("", body.lower())) for page, body in pages]
        self._pairs: list | None = None
        self._words: dict[tuple[int, int], _Page] = {}

    @property
    def pairs(self) -> list[tuple[int, str, str]]:
        if self._pairs is None:
            self._pairs = []
            for (page, body), (then, following) in zip(self.pages, self.pages[1:]):
                if page is not None and then == page + 1:
                    both = _trimmed(body) + "\n" + following
                    self._pairs.append((page, both, _NOT_WORD.sub("", both.lower())))
        return self._pairs

    def words(self, span: int, n: int) -> _Page:
        if (span, n) not in self._words:
            body = self.pairs[n][1] if span else self.pages[n][1]
            self._words[span, n] = _Page([w for w in _NOT_WORD.split(body.lower()) if w])
        return self._words[span, n]

    def find(self, quote: str, cited: int | None) -> tuple:
        """(status, page, end_page, ratio, size, run), tier after tier."""
        low = quote.lower()
        key = _NOT_WORD.sub("", low)
        if len(key) < K.LEAST_KEY:
            return ("missing", None, None, None, None, None)
        # the cited page before others, then by page
        rank = lambda page: (page != cited, page is not None, page or 0)
        if hits := [page for page, sq in self.exact if page is not None and page == cited and key in sq] or [page for page, sq in self.exact if key in sq]:
            return ("exact", min(hits, key=rank), None, 1.0, None, None)
        if hits := [page for page, _, sq in self.pairs if key in sq]:
            page = min(hits, key=rank)
            return ("exact", page, page + 1, 1.0, None, None)
        own = [w for w in _NOT_WORD.split(low) if w]
        distinct, best, place = set(own), 0.0, None
        near = []
        for span, listed in ((0, self.pages), (1, self.pairs)):
            for n, (page, *_) in enumerate(listed):
                overlap = len(distinct & self.words(span, n).set) / len(distinct)
                if overlap >= K.OVERLAP_FLOOR:
                    near.append((-overlap, rank(page), span, n, page))
        # the most promising places first; those that are as good as the best are told apart by place
        for _, order, span, n, page in sorted(near, key=lambda x: x[:4]):
            ratio_ = window_ratio(own, self.words(span, n), max(0.0, best - 1e-9))
            if ratio_ > 0:
                best = max(best, ratio_)
                this = (-round(ratio_, 9), span, order, page)
                place = this if place is None or this[:3] < place[:3] else place
        if place and -place[0] >= K.FUZZY_FLOOR:
            return ("fuzzy", place[3], place[3] + 1 if place[1] else None, -place[0], None, None)
        ratio_ = -place[0] if place else None
        needed = distinct - _STOPWORDS
        if len(needed) >= 5:
            cells = [(rank(page), covering(needed, self.words(0, n).words), page) for n, (page, _) in enumerate(self.pages) if needed <= self.words(0, n).set]
            if cells := [c for c in cells if c[1] <= 3 * len(own)]:
                _, run, page = min(cells, key=lambda c: c[:2])
                return ("assembled", page, None, ratio_, len(own), run)
        return ("missing", None, None, ratio_, None, None)


_STOPWORDS = frozenset(K.STOPWORDS)


def _located(batches: Iterator[pa.RecordBatch], fold: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document and part, its pages before its quotes: where each quote was found."""
    now, pages, document = None, [], None
    schema = pa.schema([("seq", pa.int64()), ("status", pa.string()), ("page", pa.int32()), ("end_page", pa.int32()), ("ratio", pa.float64()), ("size", pa.int32()), ("run", pa.int32())])
    for b in batches:
        out = []
        for doc, part, seq, page, text, is_quote in zip(*(b.column(c).to_pylist() for c in ("doc_id", "part", "seq", "page", "text", "is_quote"))):
            if fold and not text.isascii():
                text = unicodedata.normalize("NFKC", text)
            if now != (doc, part):
                now, pages, document = (doc, part), [], None
            if not is_quote:
                pages.append((page, text))
                continue
            # a NULL document has no pages
            document = document or _Document(pages if doc is not None else [])
            out.append((seq, *document.find(text, page)))
        columns = zip(*out) if out else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def locate(items: DataFrame, pages: DataFrame, fold: bool = True) -> DataFrame:
    """(seq, status, page, similarity, end_page) for each of ``items`` (seq unique, document, quote, page), sought on
    ``pages`` (doc_id, page, text, reading), one row a page.

    ``status`` is exact, fuzzy, assembled or missing. NULL or short quotes (fewer than 12 letters and digits) and quotes
    of documents without pages are missing; a NULL cited page has no precedence.

    Pages and quotes of a document meet once, in one task, or in several for documents of more than ``CROWD`` quotes.
    """
    quotes = items.select(F.col("document").alias("doc_id"), "seq", "page", empty(F.col("quote")).alias("text"), F.lit(True).alias("is_quote"))
    # at most one row for CROWD quotes
    crowded = quotes.groupBy("doc_id").agg(F.ceil(F.count("*") / F.lit(CROWD)).alias("parts")).where("parts > 1")
    dealt = lambda df: df.join(F.broadcast(crowded), "doc_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    asked = dealt(quotes).withColumn("part", F.pmod(F.xxhash64("seq"), F.col("parts")))
    held = pages.select("doc_id", F.lit(None).cast("long").alias("seq"), "page", searchable(F.col("text"), F.col("reading")).alias("text"), F.lit(False).alias("is_quote"))
    held = dealt(held).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = asked.unionByName(held).drop("parts").repartition(4 * tasks, "doc_id", "part").sortWithinPartitions("doc_id", "part", "is_quote", "page")
    found = written(both.mapInArrow(partial(_located, fold=fold), FOUND), "found")
    ratio_ = F.bround(F.bround("ratio", 9), 3)
    similarity = F.when(F.col("status") == "assembled", F.bround(F.col("size") / F.col("run"), 3)).otherwise(F.coalesce(ratio_, F.lit(0.0)))
    return found.select("seq", "status", "page", similarity.alias("similarity"), "end_page")
