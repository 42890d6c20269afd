"""Personal details in free text: a linear-chain conditional random field over word shapes.

The field is trained on the labelled table of ``pii_labels`` (a few thousand short texts built from a seed, a
documented constant) by stochastic gradient on the conditional likelihood. Texts are cut into tokens of letters, digits
or one sign. A token's score for each label is a sum of tables looked up by the token, its neighbours, and its chunk
(what stands between white space), so a batch of texts is scored with a few numpy gathers. An upper bound of what any
path but "no detail" could gain rules out nearly all texts; the others are decoded by Viterbi in batches. The decoded
spans are then checked: a telephone number has digits enough, a street address a house number, and so on.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave.llm import plain
from bidweave.llm.pii_labels import GIVEN, LABELS, labelled

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_CHUNK = re.compile(r"\S+")
L = len(LABELS)
_INVISIBLE = {c for c, t in plain.mapping().items() if not t}


def shape(token: str) -> str:
    if token[0].isdigit():
        return f"d{min(len(token), 9)}"
    if not token[0].isalpha():
        return token if token.isascii() else "p"
    if len(token) == 1:
        return "X1" if token.isupper() else "x1"
    return "XX" if token.isupper() else "Xx" if token[0].isupper() else "x"


def _chunk_shape(chunk: str) -> str:
    """Runs of letters as ``a`` or ``A``, digits by their number, signs as they are; what repeats counts
    twice at most, so long chunks have short shapes too."""
    out = re.sub(r"[^\W\d_]+", lambda m: "A" if m.group()[0].isupper() else "a", chunk.rstrip(".,;:)"))
    out = re.sub(r"\d+", lambda m: f"{min(len(m.group()), 9)}", out)
    return re.sub(r"((?:[Aa]|\d)[^Aa\d])\1{2,}", r"\1\1", out)


def _own(token: str) -> list[str]:
    low = token.lower()
    out = ["w=" + low, "s=" + shape(token)]
    if token[0].isalpha():
        if low in GIVEN:
            out.append("given")
        if len(low) > 5:
            out.append("e=" + low[-3:])
            if low.endswith(("weg", "straße", "strasse", "gasse", "allee", "platz")):
                out.append("street")
    return out


OFFSETS = (-3, -2, -1, 0, 1, 2, 3)


class Tagger:
    """Weights of the field, and tables of scores that grow with the tokens met (and are emptied at a fixed size)."""

    MOST = 200_000
    #: Tokens of texts, padding included, that are decoded together.
    CELLS = 400_000

    def __init__(self, weights: dict[str, np.ndarray], trans: np.ndarray, start: np.ndarray):
        self.weights, self.trans, self.start = weights, trans, start
        self._clear()

    def __getstate__(self):
        return self.weights, self.trans, self.start

    def __setstate__(self, state):
        self.__init__(*state)

    def _clear(self) -> None:
        self.tokens: dict[str, int] = {"": 0}
        self.chunks: dict[str, int] = {"": 0}
        self.tok = np.zeros((1024, len(OFFSETS), L), np.float32)
        self.chk = np.zeros((1024, 3, L), np.float32)
        self.store: list[int] = []  # the tokens of all chunks met, one after another
        self.stored = np.zeros(0, np.int32)
        self.chunk_start, self.chunk_size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.shapes: dict[str, int] = {}
        self.sid = np.zeros(1024, np.int32)
        self.pair_row = np.zeros(1024, np.int32)
        rows = sorted({k.split("|")[1] for k in self.weights if k.startswith("p|")})
        self.pair_of = {r: i + 1 for i, r in enumerate(rows)}
        self.pair = np.zeros((len(rows) + 1, 64, L), np.float32)
        for k, w in self.weights.items():
            if k.startswith("p|"):
                _, r, s = k.split("|", 2)
                self.pair[self.pair_of[r], self._shape_id(s)] = w
        self.tok[0] = self._token_rows("")
        self.chk[0] = self._chunk_rows("")

    def _shape_id(self, s: str) -> int:
        return self.shapes.setdefault(s, min(len(self.shapes), 63))

    def _token_rows(self, token: str) -> np.ndarray:
        feats = _own(token) if token else ["edge"]
        out = np.zeros((len(OFFSETS), L), np.float32)
        for i, o in enumerate(OFFSETS):
            for f in feats:
                w = self.weights.get(f"{o}|{f}")
                if w is not None:
                    out[i] += w
        return out

    def _chunk_rows(self, chunk: str) -> np.ndarray:
        out = np.zeros((3, L), np.float32)
        s = _chunk_shape(chunk) if chunk else "edge"
        for i in range(3):
            w = self.weights.get(f"c{i - 1}|{s}")
            if w is not None:
                out[i] += w
        if "@" in chunk and len(chunk) > 4 and (w := self.weights.get("mail")) is not None:
            out[1] += w
        return out

    def token_id(self, token: str) -> int:
        k = self.tokens[token] = len(self.tokens)
        if k >= len(self.tok):
            self.tok = np.concatenate([self.tok, np.zeros_like(self.tok)])
            self.sid = np.concatenate([self.sid, np.zeros_like(self.sid)])
            self.pair_row = np.concatenate([self.pair_row, np.zeros_like(self.pair_row)])
        self.tok[k] = self._token_rows(token)
        self.sid[k] = self._shape_id(shape(token))
        self.pair_row[k] = self.pair_of.get(token.lower(), 0)
        return k

    def chunk_id(self, chunk: str) -> int:
        k = self.chunks[chunk] = len(self.chunks)
        if k >= len(self.chk):
            self.chk = np.concatenate([self.chk, np.zeros_like(self.chk)])
            self.chunk_start = np.concatenate([self.chunk_start, np.zeros_like(self.chunk_start)])
            self.chunk_size = np.concatenate([self.chunk_size, np.zeros_like(self.chunk_size)])
        self.chk[k] = self._chunk_rows(chunk)
        own = [self.tokens[t] if t in self.tokens else self.token_id(t) for t in TOKEN.findall(chunk)]
        self.chunk_start[k], self.chunk_size[k] = len(self.store), len(own)
        self.store += own
        return k

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all tokens of all texts, and where each text begins (one more at the end)."""
        if len(self.tokens) > self.MOST or len(self.chunks) > self.MOST:
            self._clear()
        # tokens never cross white space, so a text's tokens are those of its chunks
        get, flat, words = self.chunks.get, [], []
        for text in texts:
            own = text.split()
            words.append(len(own))
            flat += own
        ids = np.fromiter(map(get, flat, repeat(-1)), np.int64, len(flat))
        for k in np.flatnonzero(ids < 0):
            held = get(flat[k])
            ids[k] = self.chunk_id(flat[k]) if held is None else held
        sizes = self.chunk_size[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        edge = np.concatenate([[0], np.cumsum(words)])
        begin = np.concatenate([[0], ends])[edge].astype(np.int64)
        if not total:
            return np.zeros((0, L), np.float32), begin
        counts = np.diff(begin)
        store = np.fromiter(self.store, np.int32, len(self.store)) if len(self.store) != len(self.stored) else self.stored
        self.stored = store
        tid = store[np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(self.chunk_start[ids], sizes)]
        row = np.repeat(np.arange(len(texts)), counts)
        at = np.arange(len(tid))
        lo, hi = begin[row], begin[row + 1]
        score = np.zeros((len(tid), L), np.float32)
        for i, o in enumerate(OFFSETS):
            j = at + o
            near = np.where((j >= lo) & (j < hi), tid[np.clip(j, 0, len(tid) - 1)], 0)
            score += self.tok[near, i]
        own = np.repeat(np.arange(len(ids)), sizes)  # each token's chunk
        first = np.searchsorted(own, np.arange(len(ids)))
        chunk_row = row[np.minimum(first, len(row) - 1)]
        for i, o in enumerate((-1, 0, 1)):
            j = own + o
            good = (j >= 0) & (j < len(ids))
            j = np.clip(j, 0, len(ids) - 1)
            good &= chunk_row[j] == row
            score += self.chk[np.where(good, ids[j], 0), i]
        before = np.where(at > lo, self.pair_row[tid[np.maximum(at - 1, 0)]], 0)
        score += self.pair[before, self.sid[tid]]
        return score, begin

    def tag(self, texts: list[str]) -> list[np.ndarray | None]:
        """The labels of each text's tokens; None for a text of which no token has one."""
        score, begin = self.scores(texts)
        out: list[np.ndarray | None] = [None] * len(texts)
        if not len(score):
            return out
        # what the best token of each label could gain over "no detail", with the best transitions
        gain = self.trans.max() - self.trans[0, 0]
        margin = score[:, 1:].max(axis=1) - score[:, 0] + gain
        run = np.concatenate([[0], np.cumsum(np.maximum(margin, 0))])
        entry = max((self.trans[0, 1:] - self.trans[0, 0]).max(), (self.start[1:] - self.start[0]).max()) - gain
        best = run[begin[1:]] - run[begin[:-1]] + max(entry, 0)
        todo = np.flatnonzero((best > 0) & (np.diff(begin) > 0))
        todo = todo[np.argsort(np.diff(begin)[todo], kind="stable")]
        # decoded together while the padded table stays small, whatever the longest text is
        size, k = np.diff(begin)[todo], 0
        while k < len(todo):
            upto = k + max(1, min(512, int(np.searchsorted(np.arange(1, len(todo) - k + 1) * size[k:], self.CELLS, "right"))))
            part, k = todo[k:upto], upto
            for i, labels in zip(part, self._viterbi(score, begin, part)):
                if labels.any():
                    out[i] = labels
        return out

    def _viterbi(self, score: np.ndarray, begin: np.ndarray, part: np.ndarray) -> list[np.ndarray]:
        size = (begin[part + 1] - begin[part]).astype(np.int64)
        n, t = len(part), int(size.max())
        at = np.minimum(begin[part][:, None] + np.arange(t), len(score) - 1)
        s = score[at]
        v = s[:, 0] + self.start
        back = np.zeros((n, t, L), np.int8)
        for j in range(1, t):
            step = v[:, :, None] + self.trans
            back[:, j] = step.argmax(axis=1)
            new = step.max(axis=1) + s[:, j]
            v = np.where((j < size)[:, None], new, v)
        labels = np.zeros((n, t), np.int8)
        now = v.argmax(axis=1)
        for j in range(t - 1, -1, -1):
            inside = j < size
            labels[inside, j] = now[inside]
            if j:
                now = np.where(inside, back[np.arange(n), j, now], now)
        return [labels[i, : size[i]] for i in range(n)]


def _features(text: str) -> list[list[str]]:
    """For training: the names of each token's features."""
    chunks = [m.span() for m in _CHUNK.finditer(text)]
    toks = [(m.group(), m.start()) for m in TOKEN.finditer(text)]
    out, c = [], 0
    for i, (t, at) in enumerate(toks):
        while chunks[c][1] <= at:
            c += 1
        feats = []
        for o in OFFSETS:
            j = i + o
            feats += [f"{o}|{f}" for f in (_own(toks[j][0]) if 0 <= j < len(toks) else ["edge"])]
        for o in (-1, 0, 1):
            j = c + o
            feats.append(f"c{o}|" + (_chunk_shape(text[slice(*chunks[j])]) if 0 <= j < len(chunks) else "edge"))
        own = text[slice(*chunks[c])]
        if "@" in own and len(own) > 4:
            feats.append("mail")
        if i:
            feats.append(f"p|{toks[i - 1][0].lower()}|{shape(t)}")
        out.append(feats)
    return out


def _labels(parts: list[tuple[str, str]]) -> tuple[str, list[int]]:
    text = "".join(t for t, _ in parts)
    of = np.repeat([LABELS.index(x) for _, x in parts], [len(t) for t, _ in parts])
    return text, [int(of[m.start()]) for m in TOKEN.finditer(text)]


def train(rows: int = 3600, seed: int = 11, epochs: int = 8, batch: int = 64, rate: float = 0.25, decay: float = 1e-5, least: int = 3) -> Tagger:
    """Fits the field by AdaGrad on the conditional likelihood of the labelled table's texts."""
    data = [_labels(p) for p in labelled(rows, seed)]
    feats = [_features(t) for t, _ in data]
    seen: dict[str, int] = {}
    for text in feats:
        for f in text:
            for x in f:
                seen[x] = seen.get(x, 0) + 1
    ids = {f: k + 1 for k, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    width = max(len(f) for text in feats for f in text)
    coded = []
    for text in feats:
        x = np.zeros((len(text), width), np.int32)
        for i, f in enumerate(text):
            own = [ids[y] for y in f if y in ids]
            x[i, : len(own)] = own
        coded.append(x)
    w, trans, start = np.zeros((len(ids) + 1, L)), np.zeros((L, L)), np.zeros(L)
    sums = [np.full(w.shape, 1e-2), np.full(trans.shape, 1e-2), np.full(start.shape, 1e-2)]
    order = sorted(range(len(data)), key=lambda i: len(coded[i]))
    batches = [order[k : k + batch] for k in range(0, len(order), batch)]
    shuffle = np.random.default_rng(seed)
    for _ in range(epochs):
        for b in shuffle.permutation(len(batches)):
            part = [i for i in batches[b] if len(coded[i])]
            if not part:
                continue
            size = np.array([len(coded[i]) for i in part])
            n, t = len(part), size.max()
            x, y = np.zeros((n, t, width), np.int32), np.zeros((n, t), np.int64)
            for k, i in enumerate(part):
                x[k, : size[k]], y[k, : size[k]] = coded[i], data[i][1]
            live = np.arange(t) < size[:, None]
            s = w[x].sum(axis=2)
            fwd, bwd = np.zeros((n, t, L)), np.zeros((n, t, L))
            fwd[:, 0] = s[:, 0] + start
            for j in range(1, t):
                a = fwd[:, j - 1, :, None] + trans
                m = a.max(axis=1)
                fwd[:, j] = np.where(live[:, j, None], m + np.log(np.exp(a - m[:, None]).sum(axis=1)) + s[:, j], fwd[:, j - 1])
            for j in range(t - 2, -1, -1):
                a = trans + (s[:, j + 1] + bwd[:, j + 1])[:, None, :]
                m = a.max(axis=2)
                bwd[:, j] = np.where(live[:, j + 1, None], m + np.log(np.exp(a - m[:, :, None]).sum(axis=2)), 0)
            last = fwd[:, t - 1]
            z = last.max(axis=1) + np.log(np.exp(last - last.max(axis=1, keepdims=True)).sum(axis=1))
            p = np.exp(fwd + bwd - z[:, None, None]) * live[:, :, None]
            gold = np.eye(L)[y] * live[:, :, None]
            gw = np.zeros_like(w)
            d = (p - gold).reshape(-1, L)
            flat = x.reshape(-1, width)
            for label in range(L):
                gw[:, label] = np.bincount(flat.ravel(), weights=np.repeat(d[:, label], width), minlength=len(w))
            gt = np.zeros_like(trans)
            if t > 1:
                e = fwd[:, :-1, :, None] + trans + (s[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]
                gt = (np.exp(np.minimum(e, 0)) * live[:, 1:, None, None]).sum(axis=(0, 1)) - np.einsum("nta,ntb->ab", gold[:, :-1] * live[:, 1:, None], gold[:, 1:])
            gs = (p[:, 0] - gold[:, 0]).sum(axis=0)
            gw[0] = 0
            for value, grad, total in ((w, gw, sums[0]), (trans, gt, sums[1]), (start, gs, sums[2])):
                grad = grad / n + decay * value
                total += grad * grad
                value -= rate * grad / np.sqrt(total)
    return Tagger({f: w[k].astype(np.float32) for f, k in ids.items()}, trans.astype(np.float32), start.astype(np.float32))


@lru_cache(maxsize=1)
def tagger() -> Tagger:
    return train()


def _readable(text: str) -> tuple[str, np.ndarray | None]:
    """The text with wide, look-alike and invisible characters in their plain form, and where each character stood."""
    if text.isascii():
        return text, None
    table, out, at = plain.mapping(), [], []
    for i, c in enumerate(text):
        if c in _INVISIBLE or unicodedata.combining(c):
            continue
        for p in table.get(c) or plain.LOOKALIKES.get(c, c):
            out.append(p)
            at.append(i)
    return "".join(out), np.array([*at, len(text)])


_DIGITS = re.compile(r"\d")
_NOT_NAMES = frozenset("street road avenue lane court way parkway boulevard hall county foundation llc inc ltd company group building tower bridge university section the and of for attn contact".split())


def _sound(kind: str, span: str, before: str) -> bool:
    """The check that follows decoding."""
    digits = len(_DIGITS.findall(span))
    if kind == "phone":
        return 7 <= digits <= 18
    if kind == "email":
        return bool(re.search(r"(?i)[\w.+-]+\s*(?:@|[(\[{]\s*at\s*[)\]}]|\bat\b)\s*[\w-]+", span))
    if kind == "id_number":
        return digits >= 4
    if kind == "address":
        return digits >= 1 and bool(re.search(r"[^\W\d_]{2,}", span))
    words = re.findall(r"[^\W\d_]+", span)
    if digits or not any(len(x) > 1 for x in words):
        return False
    # a given name or a form of address makes a name of words that are streets, halls and firms elsewhere, and of small letters
    called = len(words) > 1 and words[0].lower() in GIVEN and not _FIRM.search(span) or bool(_ADDRESSED.search(before))
    if called:
        return any(len(x) > 1 and x.lower() not in _NEVER for x in words)
    return any(len(x) > 1 and x.lower() not in _NOT_NAMES and x[0].isupper() for x in words) and not any(x.lower() in ("llc", "inc", "foundation", "county", "hall") for x in words)


_FIRM = re.compile(r"(?i)\b(?:llc|inc|ltd|foundation|county|company|group|university)\b")
_ADDRESSED = re.compile(r"(?i)\b(?:mrs?|ms|dr|prof|herr|frau|sra?|mme|m)\.?\s*$")
_NEVER = frozenset("the and of for attn contact section".split())
_TRIM = {"name": " ,;:-(<", "email": " ,;:-(<>", "phone": " ,;:-<", "id_number": " ,;:-(<#", "address": " ,;:-(<"}


def spans(text: str, labels: np.ndarray) -> list[tuple[int, int, str]]:
    """(begin, end, type) of the details, from the labels of the tokens of the readable form."""
    read, at = _readable(text)
    out: list[tuple[int, int, str]] = []
    toks = list(TOKEN.finditer(read))
    i = 0
    while i < len(toks):
        k = int(labels[i])
        j = i
        while j + 1 < len(toks) and labels[j + 1] == k:
            j += 1
        if k:
            kind = LABELS[k]
            a, b = toks[i].start(), toks[j].end()
            while a < b and read[a] in _TRIM[kind]:
                a += 1
            while b > a and (read[b - 1] in " ,;:-<>" or read[b - 1] == "." and kind != "name" or read[b - 1] == ")" and "(" not in read[a:b]):
                b -= 1
            if a < b and _sound(kind, read[a:b], read[max(0, a - 20) : a]):
                out.append((a, b, kind) if at is None else (int(at[a]), int(at[b - 1]) + 1, kind))
        i = j + 1
    return out


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(out) + text[at:]


def _run(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            keys, fields = batch.column("key").to_pylist(), batch.column("field").to_pylist()
            texts = batch.column("text").to_pylist()
            tags, lo = [], 0
            ends = np.cumsum([len(t) for t in texts])
            while lo < len(texts):  # a text at least, and so many as keep their scores small
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHARS, "right")))
                tags += model.tag([_readable(t)[0] for t in texts[lo:hi]])
                lo = hi
            out: dict[str, list] = {k: [] for k in ("key", "field", "types", "spans", "redacted")}
            for key, field, text, labels in zip(keys, fields, texts, tags):
                found = spans(text, labels) if labels is not None else []
                if found:
                    row = (key, field, sorted({k for _, _, k in found}), [{"begin": a, "end": b, "type": k} for a, b, k in found], redacted(text, found))
                    for c, v in zip(out, row):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_FOUND)

    return run


#: Characters of texts that are scored together.
CHARS = 2_000_000
_FOUND = pa.schema([("key", pa.int64()), ("field", pa.string()), ("types", pa.list_(pa.string())),
                    ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("type", pa.string())]))), ("redacted", pa.string())])


def details(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, types, spans, redacted) for each value with a personal detail: the kinds found, their places in
    code points, and the value with ``[name]``, ``[email]``, ``[phone]``, ``[id_number]`` or ``[address]`` in their
    place and all else unchanged.

    NULL and empty values and values without details give no row; a NULL key stays out; rows that repeat a key give rows
    that repeat; other columns are ignored; whole values are looked at.
    """
    shared = df.sparkSession.sparkContext.broadcast(tagger())  # the size of the labelled table's features
    pieces = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]))
    long = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), pieces.alias("v")).select("key", "v.field", "v.text").where("text IS NOT NULL AND text <> ''")
    return long.mapInArrow(_run(shared), "key long, field string, types array<string>, spans array<struct<begin int, end int, type string>>, redacted string")
