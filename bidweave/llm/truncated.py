"""Values that were cut off, and how often each source cuts.

For each source and column the lengths of values without terminal punctuation are counted in characters and in bytes. A
limit shows as a spike at the maximum: far more values than the lengths before it lead to expect, and next to none
beyond. A value at a spike's length (or a step short of it, where the cut fell on a space or inside a character) without
terminal punctuation is cut.

Values cut in transfer have any length. They show by what the cut left (an ellipsis, a broken character, a hyphen, a
comma), by a source that otherwise always ends its values, or by their end: the last word, or the last few words with
names, numbers and other content words masked, which in the whole corpus hardly ever end a sentence. These counts are
taken over all values; partitions send one row for each ending they saw.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidweave.session import written

#: What may stand at the end of a finished value.
TERMINAL = r"[.!?;:)\]}\"'”’»。．！？；：]\s*$"
#: What ends a sentence; at the length of a limit nothing else counts as an end.
SENTENCE = r"[.!?。．！？][)\]}\"'”’»]*\s*$"
#: What only a cut leaves at the end: an ellipsis, a broken character, a hyphen behind a letter, a comma, an open bracket, a broken character reference.
MARK = r"(?:\.\.\.|…|\x{FFFD}|\p{L}-|[,(\[{</]|&(?:#\w{0,6}|am?p?|lt?|gt?|qu?o?t?|nb?s?p?|apo?s?)?|\s[-–—])\s*$"
#: A limit's spike: at least so many values, and so many times what the lengths before it lead to expect.
LEAST, TIMES = 4, 6
#: Share of the spike that may lie beyond it, and share of unfinished values up to which a source counts as one that
#: always ends its values.
BEYOND, HABIT = 0.05, 0.02
#: An ending seen so often, of which at most this share ended a sentence, ends none.
SEEN, ENDS = 60, 0.01
GRAMS = (2, 3, 4, 6)
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d[\d.,:/%-]*|[.;!?,:(]")
# English function words, which keep their form when an ending is masked.
FUNCTION = frozenset(
    "a an the this that these those each every any all some no not and or but nor so if unless while when where whether which who whose what than then as at by "
    "for from in into of off on onto out over per through to toward under until up upon via with within without before after during between among about above below "
    "against because despite except including regarding like is are was were be been being has have had do does did can could may might must shall should will would "
    "its their his her our your it they we you he she i one two both either neither only also just more most less least such own same other another".split())


def _masked(token: str) -> str:
    if token[0].isdigit():
        return "#"
    if token in FUNCTION or not token[0].isalpha():
        return token
    return "N" if token[0].isupper() else "w"


class _Codes:
    """64-bit codes of tokens, masked and as they are; 0 ends a sentence."""

    def __init__(self) -> None:
        self.held: dict[str, tuple[int, int, int]] = {}

    def of(self, token: str) -> tuple[int, int, int]:
        code = self.held.get(token)
        if code is None:
            if len(self.held) > 500_000:
                self.held.clear()
            kind = 2 if token in ".;!?" else 1 if token in ",:(" else 0
            code = self.held[token] = (_hash(_masked(token)), _hash("#" if token[0].isdigit() else token.lower()), kind)
        return code


def _hash(text: str) -> int:
    value = 14695981039346656037
    for b in text.encode("utf-8", "surrogatepass"):
        value = (value ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return value


def _grams(masked: np.ndarray, real: np.ndarray) -> list[np.ndarray]:
    """Codes of the endings at each token: the word itself, then the masked runs of ``GRAMS`` tokens."""
    out, code, have = [real * np.uint64(11)], masked.copy(), 1
    for k in range(2, max(GRAMS) + 1):
        shifted = np.concatenate([np.zeros(k - 1, np.uint64), masked[: -(k - 1)]]) if len(masked) >= k else np.zeros(len(masked), np.uint64)
        code = (code ^ (code >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + shifted
        if k in GRAMS:
            out.append(code * np.uint64(2 * k + 1) + np.uint64(k))
            have += 1
    return out


_PAD = max(GRAMS)


def _encode(texts: list[str], codes: _Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Masked codes, real codes, kinds of all tokens, with padding before each text, and where each text ends."""
    masked, real, kind, ends = [], [], [], []
    pad = (0, 0, 3)
    of, find = codes.of, _TOKEN.findall
    for text in texts:
        rows = [pad] * _PAD + [of(t) for t in find(text)]
        m, r, k = zip(*rows)
        masked += m
        real += r
        kind += k
        ends.append(len(masked))
    return np.array(masked, np.uint64), np.array(real, np.uint64), np.array(kind, np.int8), np.array(ends, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, whole: not known to be cut) -> (code, seen, ended), added up over the partition."""
    codes, sums, held = _Codes(), [], 0

    def total() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = np.concatenate([s[0] for s in sums])
        u, inv = np.unique(key, return_inverse=True)
        return u, *(np.bincount(inv, weights=np.concatenate([s[i] for s in sums])).astype(np.int64) for i in (1, 2))

    for batch in batches:
        texts, whole = batch.column("text").to_pylist(), batch.column("whole").to_numpy(zero_copy_only=False)
        if not texts:
            continue
        masked, real, kind, ends = _encode(texts, codes)
        after = np.concatenate([kind[1:], [3]])
        last = ends[whole] - 1
        ended = (after == 2).astype(np.int64)
        ended[last] = 1
        word = kind == 0
        for key in _grams(masked, real):
            u, inv = np.unique(key[word], return_inverse=True)
            sums.append((u, np.bincount(inv), np.bincount(inv, weights=ended[word])))
            held += len(u)
        if held > 2_000_000:
            sums = [total()]
            held = len(sums[0][0])
    if sums:
        u, seen, ended = total()
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(seen), pa.array(ended)], names=["code", "seen", "ended"])


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text) -> (rid, length of the ending, code)."""
    codes = _Codes()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        if not texts:
            continue
        masked, real, kind, ends = _encode(texts, codes)
        at = ends - 1
        good = kind[at] == 0
        rid = batch.column("rid").to_numpy()[good]
        for k, key in zip((1, *GRAMS), _grams(masked, real)):
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(np.full(len(rid), k, np.int32)), pa.array(key[at[good]].view(np.int64))], names=["rid", "k", "code"])


def _spikes(lengths: DataFrame) -> DataFrame:
    """(source, field, unit, at): lengths at which a source's values of a field are cut. ``lengths`` is
    (source, field, unit, length, n): unfinished values by length."""
    own = Window.partitionBy("source", "field", "unit")
    order = own.orderBy("length")
    before = F.coalesce(F.sum("n").over(order.rangeBetween(-25, -4)), F.lit(0)) / 22
    beyond = F.coalesce(F.sum("n").over(order.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    found = lengths.withColumn("expected", before).withColumn("beyond", beyond).where(
        (F.col("n") >= LEAST) & (F.col("n") >= TIMES * F.col("expected") + 3 * F.sqrt("expected")) & (F.col("beyond") <= BEYOND * F.col("n") + 1))
    return found.select("source", "field", "unit", F.col("length").alias("at"))


def _long(df: DataFrame, key: str, source: str, fields: list[str]) -> DataFrame:
    """(key, source, field, text) of values with any text."""
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]))
    named = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), values.alias("v"))
    return named.select("key", "source", "v.field", "v.text").where(F.col("text").rlike(r"\S"))


def _unfinished(text: Column) -> Column:
    end = F.substring(text, -8, 8)
    return ~end.rlike(TERMINAL) | end.rlike(MARK)


def truncated(df: DataFrame, key: str, source: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(cut, values)``. ``cut`` is (key, source, field, reason), one row for each value that was cut; ``reason`` is
    ``mark``, ``limit``, ``habit`` or ``ending``. ``values`` is (key, source, field), every value that has text.

    NULL, empty and blank values are neither; a NULL key stays out, a NULL source is a source of its own; rows that
    repeat a key count once in both results (and once each in the length counts); further columns are ignored; an empty
    table gives empty results. Whole values are looked at.
    """
    long = _long(df, key, source, fields).withColumn("open", _unfinished(F.col("text"))).withColumn("soft", ~F.col("open") & ~F.substring("text", -8, 8).rlike(SENTENCE))
    facts = long.withColumns({
        "chars": F.length("text"), "bytes": F.octet_length("text"), "mark": F.substring("text", -8, 8).rlike(MARK)})
    values = facts.select("key", "source", "field").distinct()
    # all that follows the first pass needs only the values left open, and those that end on a bracket or the like, a small
    # part of the table
    opened = written(facts.where("open OR soft").dropDuplicates(["key", "field"]).withColumn("rid", F.xxhash64("key", "field")), "open")
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
    lengths = opened.where("open").select("source", "field", units.alias("u")).groupBy("source", "field", F.col("u.unit").alias("unit"), F.col("u.length").alias("length")).agg(F.count("*").alias("n"))
    spikes = written(_spikes(lengths), "spikes")
    at = spikes.groupBy("source", "field").agg(
        F.collect_set(F.when(F.col("unit") == "chars", F.col("at"))).alias("c"), F.collect_set(F.when(F.col("unit") == "bytes", F.col("at"))).alias("b"))
    short = lambda column, spans, steps: F.exists(F.coalesce(F.col(spans), F.array().cast("array<int>")), lambda x: (F.col(column) <= x) & (F.col(column) >= x - steps))
    held = opened.join(at, ["source", "field"], "left").withColumn(
        # what ends on a bracket or the like must lie at the limit itself
        "limit", F.when(F.col("open"), short("chars", "c", 1) | short("bytes", "b", 3)).otherwise(short("chars", "c", 0) | short("bytes", "b", 0))).drop("c", "b")
    sizes = facts.groupBy("source", "field").agg(F.count("*").alias("all"))
    loose = held.where("open AND NOT mark AND NOT limit")
    habits = (
        loose.groupBy("source", "field").agg(F.count("*").alias("loose")).join(sizes, ["source", "field"])
        .where((F.col("loose") <= HABIT * F.col("all")) & (F.col("all") >= 50)).select("source", "field", F.lit(True).alias("habit"))
    )
    loose = loose.join(habits, ["source", "field"], "left").withColumn("habit", F.coalesce("habit", F.lit(False)))
    # how often endings end a sentence, over all values; values known to be cut end none
    finished = facts.where("NOT open").select("text", F.lit(True).alias("whole"))
    rest = held.where("open").select("text", (~F.col("mark") & ~F.col("limit")).alias("whole"))
    counts = finished.unionByName(rest).mapInArrow(_count, "code long, seen long, ended long").groupBy("code").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"))
    keys = loose.where("NOT habit").select("rid", "text").mapInArrow(_endings, "rid long, k int, code long")
    # each value has added one to its own ending
    seen, ended = F.col("seen") - 1, F.col("ended") - 1
    often = seen >= SEEN
    last = (F.col("k") == 1) & ((seen == 0) | (often & (ended <= ENDS * seen)))
    # of the longer endings the longest that is seen often decides
    longest = F.max_by(ended <= ENDS * seen, F.when((F.col("k") > 1) & often, F.col("k")))
    endings = keys.join(counts, "code").groupBy("rid").agg((F.bool_or(last) | F.coalesce(longest, F.lit(False))).alias("ending")).where("ending")
    known = held.where("open AND mark OR limit").select("key", "source", "field", F.when(F.col("mark"), F.lit("mark")).otherwise(F.lit("limit")).alias("reason"))
    rest = loose.join(endings, "rid", "left").where("habit OR ending").select("key", "source", "field", F.when(F.col("habit"), F.lit("habit")).otherwise(F.lit("ending")).alias("reason"))
    return known.unionByName(rest), values


def rates(cut: DataFrame, values: DataFrame) -> DataFrame:
    """(source, values, cut, rate, items, cut_items, item_rate) for each source: of its values and of its records, how
    many were cut."""
    whole = values.groupBy("source").agg(F.count("*").alias("values"), F.count_distinct("key").alias("items"))
    part = cut.groupBy("source").agg(F.count("*").alias("cut"), F.count_distinct("key").alias("cut_items"))
    both = whole.join(part, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("cut", "cut_items")})
    return both.select("source", "values", "cut", (F.col("cut") / F.col("values")).alias("rate"), "items", "cut_items", (F.col("cut_items") / F.col("items")).alias("item_rate"))
