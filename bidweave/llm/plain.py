"""One form for text that looks the same.

A mapping is worked out once from Unicode's own data and a short table of look-alike letters, checked for conflicts, and
compiled into a transducer. Its input units are grapheme clusters, taken as long as they go: a letter with its separate
accents and the invisible characters between them is one unit. For each unit it has two outputs, one that keeps letters
of other scripts and one that maps look-alikes, and says whether the unit is Latin, a look-alike or of another script. It
reads a text once, from left to right. Both outputs of a word are held until it is clear which one is right: at the
word's end if that word is Latin but for look-alikes or has letters of its own script, and at the next word if it
consists of look-alikes alone, which stand for Latin ones unless a neighbour is of another script.

Text of plain ASCII never reaches Python; in other texts words of plain ASCII are copied in runs.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and the Latin letters they can't be told from.
LOOKALIKES = {
    # Cyrillic, small
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    # Cyrillic, capital
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "У": "Y", "І": "I", "Ѕ": "S", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ԍ": "G",
    # Greek, small
    "ο": "o", "ν": "v", "α": "a", "ι": "i", "ρ": "p", "υ": "u", "κ": "k", "χ": "x", "γ": "y", "τ": "t", "ε": "e",
    "η": "n", "ω": "w", "ϲ": "c", "ϳ": "j",
    # Greek, capital
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    # Armenian and Cherokee letters in common use as look-alikes
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꮶ": "K", "Ꮇ": "M",
    # letters of the phonetic alphabet
    "ɡ": "g", "ɑ": "a", "ɩ": "i",
}


def _accented() -> dict[str, str]:
    """The same letters with accents in one piece, where the Latin letter has that form too."""
    out = {}
    for code in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in LOOKALIKES:
            form = unicodedata.normalize("NFC", LOOKALIKES[parts[0]] + parts[1:])
            if len(form) == 1:
                out[chr(code)] = form
    return out


LOOKALIKES |= _accented()
#: Invisible although not of the category Cf.
BLANKS = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0\u2800"
#: Of the category Cf but seen.
SEEN = set("\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd")
JOINERS = "\u200c\u200d"


def _needs_joiner(ch: str) -> bool:
    """Whether joiners are part of the spelling after this character: Arabic, Indic and South-East Asian scripts,
    Mongolian, pictographs."""
    c = ord(ch)
    return 0x0600 <= c <= 0x109F or 0x1780 <= c <= 0x18AF or 0x1F000 <= c <= 0x1FAFF or 0x2600 <= c <= 0x27BF or c == 0xFE0F


@lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """Source -> target for everything but look-alikes; raises if a source had two targets or a target were a source."""
    out: dict[str, str] = {}

    def put(source: str, target: str) -> None:
        if out.setdefault(source, target) != target:
            raise ValueError(f"{source!r} has two targets")

    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        kind, parts = unicodedata.category(ch), unicodedata.decomposition(ch)
        if kind == "Zs":
            put(ch, " ")
        elif ch in BLANKS or (kind == "Cf" and ch not in SEEN) or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or 0x80 <= code <= 0x9F and code != 0x85:
            put(ch, "")
        elif parts.startswith(("<wide>", "<narrow>")):
            put(ch, unicodedata.normalize("NFKC", ch))
        elif parts.startswith("<compat>") and "LIGATURE" in unicodedata.name(ch, "") and unicodedata.name(ch).startswith("LATIN"):
            put(ch, unicodedata.normalize("NFKC", ch))
    for code in [*range(0, 9), 0x0B, *range(0x0E, 0x20), 0x7F]:
        put(chr(code), "")
    for source, target in out.items():
        if any(c in out for c in target):
            raise ValueError(f"the target of {source!r} would be mapped again")
    if not set(LOOKALIKES).isdisjoint(out):
        raise ValueError("a look-alike letter has a second mapping")
    return out


def _ranges(chars: list[str]) -> str:
    """A character class."""
    codes, out = sorted(map(ord, chars)), []
    start = last = codes[0]
    for c in [*codes[1:], None]:
        if c is None or c != last + 1:
            out.append(re.escape(chr(start)) if start == last else f"{re.escape(chr(start))}-{re.escape(chr(last))}")
            start = c
        last = c
    return "[" + "".join(out) + "]"


#: What a unit is: Latin, a look-alike, a letter of another script, any letter at all.
LATIN, ALIKE, OTHER = 1, 2, 4


def _latin(ch: str) -> bool:
    return ch < "\u0250" and ch not in "\u00b5\u00aa\u00ba" or "\u1e00" <= ch <= "\u1eff"


class Transducer(dict):
    """Unit -> (output that keeps other scripts, output with look-alikes mapped, what it is). Units are compiled from the
    mapping when they first occur; there are few different ones, and no more than ``most`` are held."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most, self.table = most, mapping()
        unseen = [c for c, t in self.table.items() if not t]
        marks = "".join(_ranges([chr(c) for c in range(0x80, 0x20000) if unicodedata.combining(chr(c))])[1:-1])
        unseen = _ranges(unseen)[1:-1]
        letter = rf"(?:[^\W\d_]|[{marks}{unseen}])"
        # a word with anything but plain letters in it, or other signs that aren't plain
        self.odd = re.compile(rf"(?<![A-Za-z])([A-Za-z]*+(?![A-Za-z]){letter}+)|[^\t\n\f\r\x20-\x7e]")
        self.units = re.compile(rf"[^{marks}{unseen}](?:[{unseen}]*[{marks}]+)*|[{unseen}]+[{marks}]*|[{marks}]+")
        self.plain_letter = re.compile("[A-Za-z]")

    def __missing__(self, unit: str) -> tuple[str, str, int]:
        kept = "".join(ch if ch in JOINERS and _needs_joiner(unit[k - 1 : k] or " ") else self.table.get(ch, ch) for k, ch in enumerate(unit))
        kept = unicodedata.normalize("NFC", kept) if any(map(unicodedata.combining, kept)) else kept
        alike = unicodedata.normalize("NFC", "".join(LOOKALIKES.get(c, c) for c in kept)) if any(c in LOOKALIKES for c in kept) else kept
        kind = 0
        for c in kept:
            if c.isalpha():
                kind |= ALIKE if c in LOOKALIKES else LATIN if _latin(c) else OTHER
        if len(self) >= self.most:
            self.clear()
        self[unit] = kept, alike, kind
        return self[unit]

    def word(self, word: str, before: str) -> tuple[str, str, int]:
        """Both outputs of a word and what its units are together; ``before`` is the character in front of it."""
        kept, alike, kind = "", "", 0
        for unit in self.units.findall(word):
            if unit[0] in JOINERS and _needs_joiner(before):
                k = a = unit[0]
                if len(unit) > 1:
                    k, a = (unit[0] + x for x in self[unit[1:]][:2])
                of = 0
            else:
                k, a, of = self[unit]
            kept, alike, kind, before = kept + k, alike + a, kind | of, unit[-1]
        return kept, alike, kind

    def run(self, text: str) -> str:
        """The plain form of ``text``, in one pass."""
        out: list[str] = []
        at, left = 0, 0  # where the input is; what the word before is
        waiting: tuple[int, str, str] | None = None  # a place in the output, and both outputs of a word of look-alikes alone
        for m in self.odd.finditer(text):
            gap = text[at : m.start()]
            if gap:
                out.append(gap)
                if self.plain_letter.search(gap):
                    if waiting:
                        out[waiting[0]], waiting = waiting[2], None
                    left = LATIN
            at = m.end()
            if m.group(1) is None:
                out.append(self.table.get(m.group(), m.group()))
                continue
            kept, alike, kind = self.word(m.group(1), text[m.start() - 1 : m.start()] or " ")
            if not kind:  # nothing but invisible characters or accents: no word
                out.append(kept)
                continue
            if waiting:
                out[waiting[0]] = waiting[1] if kind & OTHER else waiting[2]
                waiting = None
            if kind & OTHER or not kind & ALIKE:
                out.append(kept)
            elif kind & LATIN:
                out.append(alike)
            else:
                if left & OTHER:
                    out.append(kept)
                else:
                    waiting = len(out), kept, alike
                    out.append(kept)
            left = kind
        if waiting:
            out[waiting[0]] = waiting[2]
        return "".join(out) + text[at:]


@lru_cache(maxsize=1)
def _transducer() -> Transducer:
    return Transducer()


def plain(text: str) -> str:
    """``text`` in its plain form. It is a fixed point: plain(plain(x)) == plain(x)."""
    return _transducer().run(text)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text").to_pylist()
        form = [plain(t) for t in text]
        keep = [batch.column(c) for c in batch.schema.names]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(form, pa.string())], names=[*batch.schema.names, "plain"])


def to_plain(df: DataFrame) -> DataFrame:
    """(kind, id, text) -> (kind, id, text, plain) with every text in its plain form.

    NULL stays NULL, the empty text stays empty, texts of plain ASCII are passed on without leaving the JVM. Rows that
    repeat stay; ids are not looked at.
    """
    df = df.select("kind", "id", "text")
    odd = F.coalesce(F.col("text").rlike(r"[^\t\n\f\r\x20-\x7e]"), F.lit(False))
    rest = df.where(~odd).withColumn("plain", F.col("text"))
    done = df.where(odd).mapInArrow(_apply, "kind string, id long, text string, plain string")
    return done.unionByName(rest)
