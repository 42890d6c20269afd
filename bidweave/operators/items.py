"""Items: coercion, verification, corrections, merging of repeats, amendments."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidweave.functions import constants as K
from bidweave.functions import dates as D
from bidweave.functions.text import empty, has, json_body, strip, words
from bidweave.operators.quotes import ratio_beyond
from bidweave.session import written

RAW = "array<struct<kind string, statement string, quote string, page string, date string, time string, weight string>>"


def category(kind: Column) -> Column:
    """The category of a kind; an unknown one is a requirement."""
    pairs = [F.lit(x) for c, kinds in K.CATEGORIES.items() for k in kinds for x in (k, c)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit("requirement"))


def verified(verification: Column) -> Column:
    return F.coalesce(verification.isin("exact", "fuzzy", "assembled"), F.lit(False))


def coerce(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Items of replies: (all other columns, idx, kind, statement, quote, page, cited_page, date, time, weight).

    A reply is an object with ``items``, perhaps fenced or in prose, or several objects one after another that each have a quote. Items of
    unknown kind or without a quote are dropped; a page counts only as a whole number; everything else becomes text
    without white space at its ends. Replies without readable items give no rows.
    """
    others = [c for c in replies.columns if c != reply]
    body = json_body(F.col(reply))
    whole = F.from_json(body, "items " + RAW)["items"]
    # objects side by side, as a model without a schema writes them: made an array by commas between them
    loose = F.from_json(F.concat(F.lit("["), F.regexp_replace(body, r"\}[\s,]*\{", "},{"), F.lit("]")), RAW)
    several = F.when((F.size(loose) > 1) & F.forall(loose, lambda o: o["quote"].isNotNull()), loose)
    raw = replies.select(*others, F.posexplode(F.coalesce(whole, several)).alias("idx", "i"))
    text = lambda f: strip(empty(F.col("i." + f)))
    page = F.when(F.col("i.page").rlike(r"^-?\d+$"), F.col("i.page").try_cast("int"))
    out = raw.select(*others, "idx", F.col("i.kind").alias("kind"), text("statement").alias("statement"), text("quote").alias("quote"), page.alias("page"), page.alias("cited_page"), text("date").alias("date"), text("time").alias("time"), text("weight").alias("weight"))
    return out.where(F.col("kind").isin(K.KINDS) & (F.col("quote") != ""))


def verify(items: DataFrame, located: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kept, rejected)``: items with the place at which their quote was found, warnings added where the page moved or
    the words were put together from a table; items whose quote is missing."""
    found = located.select("seq", F.col("status").alias("__status"), F.col("page").alias("__page"), F.col("similarity").alias("__sim"), F.col("end_page").alias("__end"))
    both = items.join(found, "seq")
    cited = F.coalesce(F.col("cited_page").cast("string"), F.lit("None"))
    moved = F.when(~F.col("__page").eqNullSafe(F.col("cited_page")) & F.col("__page").isNotNull(), F.format_string("Quote found on page %d, not page %s.", F.col("__page"), cited))
    table = F.when(F.col("__status") == "assembled", F.lit("Words taken from table cells on the page, in another order."))
    full = both.withColumns({
        "verification": F.col("__status"), "similarity": F.col("__sim"), "end_page": F.col("__end"), "page": F.coalesce("__page", "page"),
        "warnings": F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.array_compact(F.array(moved, table))),
    }).drop("__status", "__page", "__sim", "__end")
    # both parts are read from one table
    full = written(full, "verified")
    return full.where("verification <> 'missing'"), full.where("verification = 'missing'")


def check_dates(items: DataFrame) -> DataFrame:
    """Items with warnings where the normalised date or time isn't written in the quote, and without unreadable dates."""
    claimed, date, time = D.parse_iso(F.col("date")), empty(F.col("date")), empty(F.col("time"))
    # read once, behind a generator that no optimisation goes through
    items = items.withColumn("__read", F.explode(F.array(F.struct(D.find_dates(F.col("quote")).alias("dates"), D.find_times(F.col("quote")).alias("times")))))
    written_, times = F.col("__read.dates"), F.col("__read.times")
    unreadable = (date != "") & claimed.isNull()
    iso = F.date_format(claimed, "yyyy-MM-dd")
    notes = F.array_compact(F.array(
        F.when(unreadable, F.concat(F.lit("Unreadable date '"), date, F.lit("' removed."))),
        F.when(claimed.isNotNull() & (F.size(written_) > 0) & ~F.array_contains(written_, F.coalesce(iso, F.lit(""))), F.format_string("Date %s is not among the dates quoted (%s).", iso, F.array_join(written_, ", "))),
        F.when(F.col("kind").isin(K.DEADLINE_KINDS) & (F.size(written_) >= 2) & D.adjacent_revision(F.col("quote")), F.lit("Two dates side by side: the first may be struck through.")),
        F.when((time != "") & (F.size(times) > 0) & ~F.array_contains(times, time), F.format_string("Time %s is not among the times quoted (%s).", time, F.array_join(times, ", "))),
    ))
    out = items.withColumn("__notes", notes).withColumn("__bad", unreadable)
    return out.withColumns({
        "warnings": F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.col("__notes")),
        "date": F.when(F.col("__bad"), F.lit("")).otherwise(F.col("date"))}).drop("__notes", "__bad", "__read")


def reclassify(items: DataFrame) -> DataFrame:
    """Kinds corrected by the statement's words, five rules in order, each seeing what the one before made."""
    s = empty(F.col("statement"))
    first = lambda p: F.regexp_instr(s, F.lit("(?iU)" + p))
    q, r = first(K.KEYWORDS["questions"]), first(K.RESPONSE_WORDS)
    steps = [
        ((F.col("kind") == "response_due") & (q > 0) & ((r == 0) | (q < r)), "questions_due"),
        (F.col("kind").isin("response_due", "questions_due") & (empty(F.col("date")) == ""), "other_deadline"),
    ]
    for when, kind in steps:
        items = items.withColumn("kind", F.when(when, F.lit(kind)).otherwise(F.col("kind")))
    general = F.col("kind").isin(K.GENERAL_KINDS)
    items = items.withColumn("kind", F.when(general & has(s, K.NAICS_CODE), F.lit("naics")).when(general & has(s, K.SET_ASIDE_WORDS), F.lit("set_aside")).otherwise(F.col("kind")))
    return items.withColumn("kind", F.when((F.col("kind") == "evaluation_factor") & has(s, K.GOALS), F.lit("participation_goal")).otherwise(F.col("kind")))


def reading_order() -> list[Column]:
    """Amendments, then the base document, then attachments; by document, page and number."""
    return [F.col("role") != "amendment", F.col("role") == "attachment", F.col("document"), F.coalesce("page", F.lit(0)), F.col("seq")]


#: Items of a block: larger groups of a package and kind are compared block by block.
BLOCK = 2048
#: Signs of a normalised text, by class, each class about a third of a usual text.
CLASSES = (" et", "aoinsr", "hldcumpfgwybvkxjqz0123456789")
#: Their number, bits of a number, and pairs looked at together.
SIGNS, WORD, PAIRS = sum(map(len, CLASSES)), 64, 4096
#: Texts against which one is compared at once, at least, and the longest text for that.
MANY, LONG = 32, 1260


class _Texts:
    """Normalised texts as numbers: lengths, how often each sign occurs, and the signs themselves."""

    def __init__(self, texts: list[str]):
        raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
        self.size = np.array([len(r) for r in raw], np.int64)
        flat = np.concatenate(raw) if raw else np.empty(0, np.uint8)
        table = np.zeros(128, np.int64)
        table[np.frombuffer("".join(CLASSES).encode(), np.uint8)] = np.arange(SIGNS)
        code = table[flat]
        self.texts = texts
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.code = code
        self.counts = np.bincount(np.repeat(np.arange(len(raw)), self.size) * SIGNS + code, minlength=len(raw) * SIGNS).reshape(-1, SIGNS).astype(np.int32)

    @cached_property
    def parts(self) -> list[_Texts]:
        """The texts' signs of each class alone. What a class has in order bounds its part of what all have in order, at a
        ninth of the cost."""
        return [_Texts([t.translate(gone) for t in self.texts]) for gone in ({ord(x): None for c in CLASSES if c != own for x in c} for own in CLASSES)]

    @cached_property
    def bits(self) -> np.ndarray:
        """Places at which a text has a sign, by sign, number and text; a bit of each number is left for the carry. Texts
        beyond ``LONG`` have none."""
        held = np.minimum(self.size, np.where(self.size > LONG, 0, LONG))
        out = np.zeros((SIGNS, max(1, -(-int(held.max(initial=0)) // (WORD - 1))), len(self.size)), np.uint64)
        own = np.repeat(np.arange(len(held)), held)
        if not len(own):
            return out
        n = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
        np.bitwise_or.at(out, (self.code[self.start[own] + n], n // (WORD - 1), own), np.uint64(1) << (n % (WORD - 1)).astype(np.uint64))
        return out

    def against(self, x: int, ys: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of text x and each of ys (none beyond ``LONG``), as ``in_order`` has
        them, but sign by sign of x over all of ys side by side."""
        n = max(1, -(-int(self.size[ys].max()) // (WORD - 1)))
        own, cols = np.unique(self.code[self.start[x]:self.start[x + 1]], return_inverse=True)
        held = np.empty((len(own), n, len(ys)), np.uint64)
        for k, c in enumerate(own):
            self.bits[c, :n].take(ys, axis=1, out=held[k], mode="clip")
        full, top = np.uint64(2 ** (WORD - 1) - 1), np.uint64(WORD - 1)
        v = np.full((n, len(ys)), full)
        u, total, carry = np.empty_like(v), np.empty_like(v), np.empty(len(ys), np.uint64)
        for c in cols:
            np.bitwise_and(v, held[c], out=u)
            np.add(v, u, out=total)
            v -= u
            for w in range(1, n):
                np.right_shift(total[w - 1], top, out=carry)
                total[w] += carry
            v |= total
            v &= full
        return (WORD - 1) * n - np.bitwise_count(v).sum(axis=0, dtype=np.int64)

    def common(self, x: int, ys: np.ndarray) -> np.ndarray:
        """Signs that text x and each of ys have in common in any order: no fewer than are matched in order."""
        return self.shared(x, ys).sum(axis=1)

    def shared(self, x: int | np.ndarray, ys: np.ndarray) -> np.ndarray:
        """The same by class."""
        return np.add.reduceat(np.minimum(self.counts[ys], self.counts[x]), np.cumsum([0, *map(len, CLASSES[:-1])]), axis=1)

    def in_order(self, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of pairs of texts: no less than is matched."""
        out = np.zeros(len(xs), np.int64)
        longest = np.maximum(self.size[xs], self.size[ys])
        order, at = np.argsort(longest), 0
        while at < len(order):
            # pairs of about one length; fewer of long texts, for memory
            most = longest[order[min(at + PAIRS, len(order)) - 1]]
            now = order[at:at + max(1, min(PAIRS, 2**21 // (most + 1)))]
            out[now] = self._columns(xs[now], ys[now])
            at += len(now)
        return out

    def _columns(self, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        """Bit-parallel columns over all pairs at once: a number holds ``WORD`` places of x."""
        own, inverse = np.unique(xs, return_inverse=True)
        words_, most = -(-int(self.size[own].max()) // WORD), int(self.size[ys].max())
        # places at which x has a sign; none for the places behind the end of y
        bits = np.zeros((words_, len(own) * (SIGNS + 1)), np.uint64)
        for k, x in enumerate(own):
            n = np.arange(self.size[x])
            np.bitwise_or.at(bits, (n // WORD, k * (SIGNS + 1) + self.code[self.start[x]:self.start[x + 1]]), np.uint64(1) << (n % WORD).astype(np.uint64))
        step = np.arange(most)[:, None]
        cols = np.where(step < self.size[ys], self.code.take(self.start[ys] + step, mode="clip") if most else 0, SIGNS)
        base = inverse * (SIGNS + 1)
        v = np.full((words_, len(xs)), ~np.uint64(0))
        for col in cols:
            at, carry = base + col, None
            for w in range(words_):
                u = bits[w].take(at)
                u &= v[w]
                total = v[w] + u
                over = total < u
                if carry is not None:
                    total += carry
                    over |= total < carry
                v[w] -= u
                v[w] |= total
                carry = over.astype(np.uint64)
        return WORD * words_ - np.bitwise_count(v).sum(axis=0, dtype=np.int64)


def _twins(part: pd.DataFrame) -> pd.DataFrame:
    """Twins (a before b) of the groups that share a part, or of two blocks of a large group, which ``side`` tells apart.

    Two texts' likeness is twice the matched signs by both lengths. Matched signs are at most the signs in common, and
    at most the longest common subsequence, so pairs that these rule out need no comparison and none is lost.
    """
    g = part.sort_values(["package_id", "kind", "nth"], ignore_index=True)
    q, s, seq, side = g["q"].tolist(), g["s"].tolist(), g["seq"].to_numpy(), g["side"].to_numpy()
    tq, ts = _Texts(q), _Texts(s)
    date, weight = (np.where(g[f] == "", -1, pd.factorize(g[f])[0]) for f in ("date", "weight"))
    group = g.groupby(["package_id", "kind"], sort=False, dropna=False).ngroup().to_numpy()
    found, waiting, size = [], [], 0

    def reach(t: _Texts, matched: np.ndarray, x: np.ndarray | int, y: np.ndarray, least: float | np.ndarray) -> np.ndarray:
        both = t.size[x] + t.size[y]
        return (both == 0) | (2.0 * matched > least * both)

    def rare_first(t: _Texts, matched: Callable, x: np.ndarray | int, y: np.ndarray, shared: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which pairs are still within reach once each class counts only as far as it stands in order, until few are left."""
        left, total, pick = np.arange(len(y)), shared.sum(axis=1), lambda c, k: c[k] if isinstance(c, np.ndarray) else c
        for k in range(len(CLASSES))[::-1]:
            if len(left) < MANY:
                break
            total += matched(t.parts[k], pick(x, left), y[left]) - shared[left, k]
            keep = reach(t, total, pick(x, left), y[left], least[left])
            left, total = left[keep], total[keep]
        return left

    def settle() -> None:
        x, y, high, low = (np.concatenate(c) for c in zip(*waiting))
        # statements where only they can bring the pair in, then quotes of what is left
        ask = np.flatnonzero(~high)
        low[ask] = reach(ts, ts.in_order(x[ask], y[ask]), x[ask], y[ask], 0.9)
        keep = np.flatnonzero(high | low)
        keep = keep[rare_first(tq, _Texts.in_order, x[keep], y[keep], tq.shared(x[keep], y[keep]), np.where(low[keep], 0.5, 0.8))]
        x, y, high, low = x[keep], y[keep], high[keep], low[keep]
        matched = tq.in_order(x, y)
        keep = (high & reach(tq, matched, x, y, 0.8)) | (low & reach(tq, matched, x, y, 0.5))
        for i, j in zip(x[keep].tolist(), y[keep].tolist()):
            r = 1.0 if q[i] == q[j] else ratio_beyond(q[i], q[j], 0.5)
            if r > 0.8 or (r > 0.5 and ratio_beyond(s[i], s[j], 0.9) > 0.9):
                found.append((seq[i], seq[j]))

    for lo, hi in zip(*_runs(group)):
        for x in range(lo, hi - 1):
            y = np.arange(x + 1, hi)
            ok = ((date[y] == date[x]) | (date[y] < 0) | (date[x] < 0)) & ((weight[y] == weight[x]) | (weight[y] < 0) | (weight[x] < 0))
            y = y[ok & ((side[y] != side[x]) | (side[x] < 0))]
            # lengths alone first
            y = y[reach(tq, np.minimum(tq.size[x], tq.size[y]), x, y, 0.5)]
            shared = tq.shared(x, y)
            all_ = shared.sum(axis=1)
            high, low = reach(tq, all_, x, y, 0.8), reach(tq, all_, x, y, 0.5)
            low &= reach(ts, np.minimum(ts.size[x], ts.size[y]), x, y, 0.9)
            low[low] = reach(ts, ts.common(x, y[low]), x, y[low], 0.9)
            y, shared, high, low = (c[high | low] for c in (y, shared, high, low))
            if len(y) >= MANY and (tq.size[y] <= LONG).all():
                left = rare_first(tq, _Texts.against, x, y, shared, np.where(low, 0.5, 0.8))
                y, high, low = y[left], high[left], low[left]
            if len(y):
                waiting.append((np.full(len(y), x), y, high, low))
                size += len(y)
            if size > 16 * PAIRS:
                settle()
                waiting, size = [], 0
    if waiting:
        settle()
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _runs(codes: np.ndarray) -> tuple[list[int], list[int]]:
    """Beginnings and ends of runs of equal numbers."""
    cuts = (np.flatnonzero(np.diff(codes)) + 1).tolist()
    return [0, *cuts], [*cuts, len(codes)]


def _place() -> Column:
    """Reading order as one comparable value."""
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(reading_order())])


def twins(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pairs, copies)``. Pairs (a, pa, b): items of one package and kind that state the same, by seq, a (at place pa)
    before b in reading order. Copies (a, b): b equals a, the first of its equals, in all that is compared, so whatever
    takes a takes b; copies aren't in pairs.

    All pairs of a package and kind are looked at, but only those that bounds of the likeness leave are compared. Groups
    of more than ``BLOCK`` items are cut into blocks by a hash, a task for each two blocks; small ones share a task.
    """
    base = written(items.select(
        "package_id", "kind", "seq", _place().alias("place"), empty(F.col("date")).alias("date"), empty(F.col("weight")).alias("weight"),
        F.array_join(words(F.col("quote")), " ").alias("q"), F.array_join(words(F.col("statement")), " ").alias("s")), "merge")
    group = ["package_id", "kind"]
    equal = base.select(*group, "seq", "place", F.struct("q", "s", "date", "weight").alias("k"))
    first = equal.groupBy(*group, "k").agg(F.min_by("seq", "place").alias("a"))
    copies = written(equal.join(first, [*group, "k"]).where("a <> seq").select("a", F.col("seq").alias("b")), "copies")
    heads = base.join(copies.select(F.col("b").alias("seq")), "seq", "left_anti")
    sized = heads.join(heads.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks")), group)
    parts = F.lit(max(1, base.count() // BLOCK))
    block = F.pmod(F.xxhash64("seq"), F.col("blocks"))
    # with more than one block, an item meets its own block and every other
    met = sized.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(*group), parts)).otherwise(F.xxhash64(*group, F.least("block", "other"), F.greatest("block", "other")))
    met = met.select(*group, key.alias("key"), F.when(F.col("block") == F.col("other"), F.lit(-1)).otherwise(F.col("block")).alias("side"), "seq", "place", "q", "s", "date", "weight")
    # reading order as text isn't needed in Python: a number for each part
    met = met.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("place", "seq"))).drop("place")
    # comparing is dear and rows are few: parts are spread over all tasks, not put together by their size
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alike = met.repartition(4 * tasks, "key").groupBy("key").applyInPandas(_twins, "a long, b long")
    return alike.join(base.select(F.col("seq").alias("a"), F.col("place").alias("pa")), "a").select("a", "pa", "b"), copies


def merge(items: DataFrame) -> DataFrame:
    """One item for each fact: repeats are folded into the first of their kind in reading order. ``seq`` is unique.

    An item is kept if no kept item before it is its twin; the first such twin absorbs it. This is settled in rounds
    over the twin table: whatever has only settled twins before it is settled next. ``also_on`` gets the absorbed
    items' pages, if these are pages of the same document, not NULL and not the item's own.
    """
    pairs, copies = twins(items)
    pairs = written(pairs, "twins")
    nodes = written(pairs.select(F.col("a").alias("seq")).union(pairs.select("b")).distinct(), "nodes")
    settled = written(nodes.join(pairs.select(F.col("b").alias("seq")).distinct(), "seq", "left_anti").select("seq", F.lit(True).alias("kept")), "settled")
    while True:  # each round settles the first of what is left, at least
        todo = nodes.join(settled, "seq", "left_anti")
        if todo.isEmpty():
            break
        known = pairs.select("a", "b").join(todo.select(F.col("seq").alias("b")), "b").join(settled.select(F.col("seq").alias("a"), "kept"), "a", "left")
        now = known.groupBy("b").agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("taken"), F.bool_and(F.col("kept").isNotNull()).alias("ready"))
        # absorbed by a kept one before it, or kept once all before it are settled
        settled = written(settled.unionByName(now.where("taken OR ready").select(F.col("b").alias("seq"), (~F.col("taken")).alias("kept"))), "settled")
    into = pairs.join(settled.where("kept").select(F.col("seq").alias("a")), "a").join(settled.where("NOT kept").select(F.col("seq").alias("b")), "b").groupBy("b").agg(F.min_by("a", "pa").alias("a"))
    # a copy goes where the first of its equals went, or to it
    led = copies.join(into.select(F.col("b").alias("a"), F.col("a").alias("__into")), "a", "left").select("b", F.coalesce("__into", "a").alias("a"))
    into = written(into.unionByName(led), "into")
    facts = items.select("seq", "document", "page")
    pages = into.join(facts.select(F.col("seq").alias("b"), F.col("document").alias("db"), F.col("page").alias("pb")), "b").join(facts.select(F.col("seq").alias("a"), F.col("document").alias("da"), F.col("page").alias("pa")), "a")
    pages = pages.where("da = db AND pb IS NOT NULL AND pb <> 0 AND NOT (pb <=> pa)").groupBy(F.col("a").alias("seq")).agg(F.array_sort(F.collect_set("pb")).alias("__pages"))
    kept = items.join(into.select(F.col("b").alias("seq")), "seq", "left_anti").join(pages, "seq", "left")
    none = F.array().cast("array<int>")
    return kept.withColumn("also_on", F.array_union(F.coalesce("also_on", none), F.coalesce("__pages", none))).drop("__pages")


def apply_amendments(items: DataFrame) -> DataFrame:
    """Base deadlines superseded by the latest date an amendment gives for their kind."""
    amended = items.where(F.col("kind").isin(K.DEADLINE_KINDS) & (F.col("role") == "amendment") & (empty(F.col("date")) != ""))
    latest = amended.groupBy("package_id", "kind").agg(F.max_by(F.struct("date", "document"), F.struct("date", -F.col("seq"))).alias("__l"))
    both = items.join(latest, ["package_id", "kind"], "left")
    late = (F.col("role") == "base") & (empty(F.col("date")) != "") & (F.col("date") != F.col("__l.date"))
    return both.withColumn("superseded_by", F.when(late, F.col("__l.document")).otherwise(F.col("superseded_by"))).drop("__l")


def live(items: DataFrame) -> DataFrame:
    """Items that nothing supersedes."""
    return items.where(empty(F.col("superseded_by")) == "")
