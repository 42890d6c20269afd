"""Near-duplicate records by prefixes of token combinations.

Two records are near-duplicates when their distinct words overlap in at least ``threshold`` of all words of the two
(Jaccard). The join is exact:

1. Words become 64-bit hashes; records with the same set of words form a class, and only one record of a class, its
   representative, is compared.
2. Tokens get one global order, rare ones first. Frequent tokens that nearly always come with another one (the fixed
   phrases of a template) tell little and go last; this changes the cost only.
3. A prefix of a record's ordered tokens is extended until, whatever tokens a near-duplicate may lack, one class of
   tokens still shares enough of them: tokens rare enough to list by themselves are signatures, of more frequent ones
   pairs are, of the most frequent ones triples. Any two near-duplicates share a signature. The frequencies at which
   pairs and triples begin follow from the number of records, so that the expected lists stay as long at every size.
4. Signatures are shuffled in column blocks, listed, and pairs on a list are sifted by size and by a 192-bit sketch of
   the words (a lower bound of the difference, so nothing is lost). A combination goes where its rarest tokens are
   listed, so a record's signatures travel together and its sketch is sent once for many of them.
5. What is left is verified on the words themselves.

Signatures of very many records are known beforehand from a sample of records (which decides on the way only, never on
the result): their lists are never gathered. Records are dealt into blocks by a hash, and each two blocks meet in a task
of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.session import written

#: Counters for the frequencies of tokens; a fixed number, so what is broadcast doesn't grow with the data.
SKETCH_BITS = 17
#: At most so many frequent tokens are tested for being part of a fixed phrase.
MOST_FREQUENT = 512
#: Sets of at most so many words may be too small to form pairs or triples; they list single words besides.
TINY = 6
SKETCH_WORDS = 3
#: Pairs sifted at once: so few that they stay in a core's cache.
PAIRS_AT_ONCE = 50_000
#: Records (about) from which signatures of long lists are foreseen.
SAMPLE = 20_000
#: Up to so many rows (16 bytes each) that repeat a class are broadcast.
FEW_COPIES = 1_000_000


def words_of(*columns: Column) -> Column:
    """Distinct words (runs of ``a-z0-9`` after lowercasing) of the columns put together with spaces; NULL counts as
    empty."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]))
    return F.array_remove(F.array_distinct(F.split(text, "[^a-z0-9]+")), "")


def tokens_of(words: Column) -> Column:
    """Sorted 64-bit hashes of words."""
    return F.array_sort(F.transform(words, lambda w: F.xxhash64(w)))


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = array.offsets.to_numpy()
    return array.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


class _Order:
    """The global order of tokens, from counters of fixed size."""

    def __init__(self, sketch: np.ndarray, tokens: np.ndarray, counts: np.ndarray, phrase: np.ndarray, n: int, list_length: int):
        by = np.argsort(tokens)
        self.sketch, self.tokens, self.counts, self.phrase = sketch, tokens[by], counts[by], phrase[by]
        self.single = max(list_length, 1)
        self.pair = max(math.sqrt(list_length * n), self.single)

    def frequency(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.sketch[(token & ((1 << SKETCH_BITS) - 1)).astype(np.int64)]
        phrase = np.zeros(len(token), bool)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, token), len(self.tokens) - 1)
            known = self.tokens[at] == token
            count = np.where(known, self.counts[at], count)
            phrase = known & self.phrase[at]
        return count, phrase


def _mix(*parts: np.ndarray) -> np.ndarray:
    out = np.full(parts[0].shape, 0x9E3779B97F4A7C15, np.uint64)
    for p in parts:
        out = (out ^ p) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def _bits(token: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """A sketch of each set: words hashed to bits, each bit the parity of its words."""
    bit = (_mix(token.view(np.uint64)) >> np.uint64(40)).astype(np.int64) % (64 * SKETCH_WORDS)
    parity = np.bincount(row * (64 * SKETCH_WORDS) + bit, minlength=n * 64 * SKETCH_WORDS).astype(np.uint8) & 1
    return np.packbits(parity.reshape(n, -1), axis=1, bitorder="little").view(np.uint64)


def _signatures(token: np.ndarray, offsets: np.ndarray, order: _Order, t: float):
    """Rows (record, signature, code of its rarest tokens, whether it lies in the shorter prefix) of a batch of sets."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    count, phrase = order.frequency(token)
    by = np.lexsort((token, count, phrase, row))
    token, count = token[by].view(np.uint64), count[by]
    kind = np.where(count <= order.single, 0, np.where(count <= order.pair, 1, 2))
    at = np.arange(len(token)) - offsets[:-1][row]
    nth = np.zeros(len(token), np.int64)  # among the record's tokens of the same kind
    for k in range(3):
        run = np.cumsum(kind == k)
        start = np.concatenate([[0], run])[offsets[:-1]]
        nth = np.where(kind == k, run - start[row], nth)
    gain = (nth > kind).astype(np.int64)
    run = np.cumsum(gain)
    before = run - gain - np.concatenate([[0], run])[offsets[:-1]][row]
    probe = size - np.ceil(t * size - 1e-9).astype(np.int64) + 1  # against any partner
    index = size - np.ceil(2 * t / (1 + t) * size - 1e-9).astype(np.int64) + 1  # against partners of its size or more
    inside, short = before < probe[row], before < index[row]
    out = []
    one = inside & (kind == 0)
    single = _mix(token[one], np.uint64(1) + np.zeros(one.sum(), np.uint64))
    out.append((row[one], single, single, short[one]))
    tiny = (size <= TINY)[row]
    single = _mix(token[tiny], np.uint64(7) + np.zeros(tiny.sum(), np.uint64))
    out.append((row[tiny], single, single, np.ones(tiny.sum(), bool)))
    for k in (1, 2):
        own = np.flatnonzero(inside & (kind == k))
        r = row[own]
        held = np.bincount(r, minlength=n)
        first = np.concatenate([[0], np.cumsum(held)])[:-1]
        for c in np.unique(held[held > k]):
            recs = np.flatnonzero(held == c)
            cell = own[first[recs][:, None] + np.arange(c)]
            tok, sh = token[cell], short[cell]
            combos = np.array(np.triu_indices(c, 1)) if k == 1 else np.array(
                [(a, b, d) for a in range(c) for b in range(a + 1, c) for d in range(b + 1, c)]).T
            sig = _mix(*[tok[:, i] for i in combos])
            lead = _mix(*[tok[:, i] for i in combos[:-1]])
            out.append((np.repeat(recs, combos.shape[1]), sig.ravel(), lead.ravel(), sh[:, combos[-1]].ravel()))
    return tuple(np.concatenate(x) for x in zip(*out)), size


def _blocks(order: _Order, t: float, buckets: int, hot: np.ndarray):
    """Arrow batches of (rid, tokens) -> one row of packed columns for each bucket; ``hot`` signatures are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            token, offsets = _flat(batch.column("tokens"))
            rid = batch.column("rid").to_numpy()
            (row, sig, lead, short), size = _signatures(token, offsets, order, t)
            bits = _bits(token, np.repeat(np.arange(len(rid)), size), len(rid))
            if len(hot):
                cold = ~_among(sig, hot)[1]
                row, sig, lead, short = row[cold], sig[cold], lead[cold], short[cold]
            to = (lead % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            row, sig, short, to = row[by], sig[by], short[by], to[by]
            cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else np.zeros(1, np.int64)
            cols: dict[str, list] = {k: [] for k in ("bucket", "rid", "size", "bits", "sig", "loc")}
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                used, loc = np.unique(row[lo:hi], return_inverse=True)
                cols["bucket"].append(int(to[lo]))
                cols["rid"].append(rid[used].tobytes())
                cols["size"].append(size[used].astype(np.uint16 if size.max() < 1 << 16 else np.uint32).tobytes())
                cols["bits"].append(bits[used].tobytes())
                # inside a bucket 32 bits tell signatures apart well enough: a clash only adds candidates
                cols["sig"].append((sig[lo:hi] >> np.uint64(32)).astype(np.uint32).tobytes())
                place = loc.astype(np.uint32) * 2 + short[lo:hi]
                cols["loc"].append(place.astype(np.uint16 if len(used) < 1 << 15 else np.uint32).tobytes())
            yield pa.RecordBatch.from_pydict(
                {"bucket": pa.array(cols["bucket"], pa.int32())} | {k: pa.array(cols[k], pa.binary()) for k in ("rid", "size", "bits", "sig", "loc")})

    return run


BLOCK = "bucket int, rid binary, size binary, bits binary, sig binary, loc binary"


def _among(values: np.ndarray, sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and whether the values are there."""
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return at, sorted_[at] == values


def _foreseen(sets: DataFrame, order: _Order, t: float, n: int, hot_list: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures that will have lists of more than about ``hot_list`` (or a thousandth of all) records, in order, and
    into how many blocks their records go. At most a thousand times the signatures of one record."""
    share = max(1, n // SAMPLE)
    least = max(hot_list, n // 1000)
    shared = sets.sparkSession.sparkContext.broadcast(order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (_, sig, _, _), _ = _signatures(*_flat(batch.column("tokens")), shared.value, t)
                sigs, counts = np.unique(sig, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(counts.astype(np.int64))], names=["sig", "n"])

    part = sets.where(F.pmod(F.xxhash64("rid"), F.lit(share)) == 0).select("tokens")
    held = part.mapInArrow(count, "sig long, n long").groupBy("sig").agg((F.sum("n") * share).alias("n")).where(F.col("n") > least).toPandas()
    sig, many = held["sig"].to_numpy(np.int64).view(np.uint64), held["n"].to_numpy(np.int64)
    by = np.argsort(sig)
    return sig[by], -(-many[by] // least)


def _hot_blocks(order: _Order, t: float, hot: np.ndarray, blocks: np.ndarray):
    """Arrow batches of (rid, tokens) -> packed records by hot signature and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            token, offsets = _flat(batch.column("tokens"))
            rid = batch.column("rid").to_numpy()
            (row, sig, _, short), size = _signatures(token, offsets, order, t)
            at, there = _among(sig, hot)
            row, at, short = row[there], at[there], short[there]
            bits = _bits(token, np.repeat(np.arange(len(rid)), size), len(rid))
            block = (_mix(rid.view(np.uint64)) >> np.uint64(33)).astype(np.int64)[row] % blocks[at]
            by = np.lexsort((block, at))
            row, at, short, block = row[by], at[by], short[by], block[by]
            packed = np.concatenate([rid[row].view(np.uint64)[:, None], size[row].astype(np.uint64)[:, None], short.astype(np.uint64)[:, None], bits[row]], axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (block[1:] != block[:-1]), [True]])) if len(at) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_pydict({
                "sig": pa.array(at[cuts[:-1]], pa.int64()), "block": pa.array(block[cuts[:-1]].astype(np.int32)), "blocks": pa.array(blocks[at[cuts[:-1]]].astype(np.int32)),
                "packed": pa.array([packed[lo:hi].tobytes() for lo, hi in zip(cuts[:-1], cuts[1:])], pa.binary())})

    return run


def _meet(t: float):
    """Rows (sig, i, j, block, packed), sorted by (sig, i, j): the pairs of blocks i and j."""

    def pairs(rows: list[tuple[int, bytes]], i: int, j: int) -> pa.RecordBatch:
        x = np.concatenate([np.frombuffer(p, np.uint64).reshape(-1, 3 + SKETCH_WORDS) for _, p in rows])
        side = np.concatenate([np.full(len(p) // (8 * (3 + SKETCH_WORDS)), b) for b, p in rows])
        by = np.argsort(x[:, 1], kind="stable")
        x, side = x[by], side[by]
        rid, size, short, bits = x[:, 0].astype(np.int64), x[:, 1].astype(np.int64), x[:, 2].astype(bool), x[:, 3:]
        found: list = []
        for a, b in {(i, j), (j, i)}:
            left, right = short & (side == a), side == b
            lo = np.searchsorted(size[right], size[left], "left")
            hi = np.searchsorted(size[right], np.floor(size[left] / t + 1e-9), "right")
            _sift(rid[right], size[right], bits[right], (rid[left], size[left], bits[left]), lo, hi, t, found)
        p = _pairs(found)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for sig, i, j, block, packed in zip(*(batch.column(c).to_pylist() for c in ("sig", "i", "j", "block", "packed"))):
                if (sig, i, j) != now and held:
                    yield pairs(held, *now[1:])
                    held = []
                now = (sig, i, j)
                held.append((block, packed))
        if held:
            yield pairs(held, *now[1:])

    return run


def _sift(rid, size, bits, left, lo, hi, t, found: list) -> None:
    """Pairs (left[i], any of lo[i]..hi[i] in list order) whose sketches don't rule a near-duplicate out."""
    (lrid, lsize, lbits), n = left, hi - lo
    if not len(n) or not len(size):
        return
    column = [np.ascontiguousarray(bits[:, w]) for w in range(SKETCH_WORDS)]
    own = [np.ascontiguousarray(lbits[:, w]) for w in range(SKETCH_WORDS)]
    # how many words of two sets may differ, by their sizes together; first by the largest partner that a set may have
    most = np.floor((1 - t) / (1 + t) * np.arange(2 * max(int(size.max()), int(lsize.max())) + 2) + 1e-9).astype(np.int64)
    loose = most[np.minimum(lsize + np.floor(lsize / t + 1e-9).astype(np.int64), len(most) - 1)]
    ends, done = np.cumsum(n), 0
    while done < len(n):
        base = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, "right")))
        k = n[done:upto]
        total = int(ends[upto - 1] - base)
        if total:
            b = np.arange(total) + np.repeat(lo[done:upto] - (ends[done:upto] - base - k), k)
            apart = np.bitwise_count(np.repeat(own[0][done:upto], k) ^ column[0][b]) + np.bitwise_count(np.repeat(own[1][done:upto], k) ^ column[1][b])
            keep = np.flatnonzero(apart <= np.repeat(loose[done:upto], k))
            a, b, apart = np.repeat(np.arange(done, upto), k)[keep], b[keep], apart[keep].astype(np.int64)
            for w in range(2, SKETCH_WORDS):
                apart += np.bitwise_count(own[w][a] ^ column[w][b])
            x, y = lrid[a], rid[b]
            keep = (apart <= most[lsize[a] + size[b]]) & (x != y)
            x, y = x[keep], y[keep]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
        done = upto


def _pairs(found: list) -> np.ndarray:
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _lists(t: float):
    """Packed blocks, sorted by bucket -> candidates."""

    def bucket_of(rows: list[dict]) -> pa.RecordBatch | None:
        rid = np.concatenate([np.frombuffer(r["rid"], np.int64) for r in rows])
        size = np.concatenate([np.frombuffer(r["size"], np.uint16 if len(r["size"]) * 4 == len(r["rid"]) else np.uint32) for r in rows]).astype(np.int64)
        bits = np.concatenate([np.frombuffer(r["bits"], np.uint64).reshape(-1, SKETCH_WORDS) for r in rows])
        sig = np.concatenate([np.frombuffer(r["sig"], np.uint32) for r in rows])
        base = np.cumsum([0] + [len(r["rid"]) // 8 for r in rows])
        packed = [np.frombuffer(r["loc"], np.uint16 if len(r["loc"]) * 2 == len(r["sig"]) else np.uint32) for r in rows]
        loc = np.concatenate([(p >> 1).astype(np.int64) + s for p, s in zip(packed, base)])
        short = np.concatenate([(p & 1).astype(bool) for p in packed])
        # signatures of one record only are dropped before anything is moved
        by = np.argsort(sig)
        same = sig[by][1:] == sig[by][:-1]
        by = by[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        sig, loc, short = sig[by], loc[by], short[by]
        if not len(sig):
            return None
        run = np.cumsum(np.concatenate([[0], sig[1:] != sig[:-1]]))
        width = int(size.max()) + 2
        by = np.argsort(run * width + size[loc])
        run, loc, short = run[by], loc[by], short[by]
        key = run * width + size[loc]
        own = np.flatnonzero(short)
        most = np.minimum(np.floor(size[loc[own]] / t + 1e-9).astype(np.int64), width - 1)
        lo = np.searchsorted(key, key[own], "left")
        hi = np.searchsorted(key, run[own] * width + most, "right")
        found: list = []
        _sift(rid[loc], size[loc], bits[loc], (rid[loc[own]], size[loc[own]], bits[loc[own]]), lo, hi, t, found)
        p = _pairs(found)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["bucket"] != r["bucket"]:
                    out, held = bucket_of(held), []
                    if out is not None:
                        yield out
                held.append(r)
        if held and (out := bucket_of(held)) is not None:
            yield out

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of a partition's sets with their counts, a batch at a time."""
    for batch in batches:
        token, _ = _flat(batch.column("tokens"))
        tokens, counts = np.unique(token, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(counts.astype(np.int64))], names=["token", "n"])


def _together(frequent: np.ndarray):
    """How often two of the frequent tokens stand in one set, added up over a partition."""
    by = np.argsort(frequent)
    sorted_ = frequent[by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(frequent)
        both = np.zeros((m, m))
        for batch in batches:
            token, offsets = _flat(batch.column("tokens"))
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            at = np.minimum(np.searchsorted(sorted_, token), m - 1)
            known = sorted_[at] == token
            for k in range(0, len(offsets) - 1, 4096):
                here = known & (row >= k) & (row < k + 4096)
                x = np.zeros((4096, m), np.float32)
                x[row[here] - k, by[at[here]]] = 1
                both += x.T @ x
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(both[i, j].astype(np.int64))], names=["i", "j", "n"])

    return run


def _order(sets: DataFrame, list_length: int) -> tuple[_Order, int]:
    counts = written(sets.select("tokens").mapInArrow(_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "counts")
    n = sets.count()
    slot = F.col("token").bitwiseAND((1 << SKETCH_BITS) - 1)
    slots = counts.groupBy(slot.alias("slot")).agg(F.max("n").alias("n")).toPandas()  # at most 2 ** SKETCH_BITS rows
    sketch = np.ones(1 << SKETCH_BITS, np.int64)
    sketch[slots["slot"].to_numpy(np.int64)] = slots["n"].to_numpy(np.int64)
    top = counts.where(F.col("n") >= max(2, n // 200)).orderBy(F.desc("n"), "token").limit(4 * MOST_FREQUENT).toPandas()
    tokens, held = top["token"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    phrase = np.zeros(len(tokens), bool)
    tested = np.flatnonzero(held <= n / 5)[:MOST_FREQUENT]
    if len(tested) > 1:
        both = (
            sets.select("tokens").mapInArrow(_together(tokens[tested]), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
            .where("i <> j").groupBy("i").agg(F.max("n").alias("n")).toPandas()  # at most MOST_FREQUENT rows
        )
        i = both["i"].to_numpy(np.int64)
        phrase[tested[i]] = both["n"].to_numpy(np.int64) >= 0.5 * held[tested[i]]
    return _Order(sketch, tokens, held, phrase, max(n, 1), list_length), n


def similar_sets(sets: DataFrame, threshold: float = 0.7, list_length: int = 2000, hot_list: int = 20_000, blocks: int | None = None) -> DataFrame:
    """Pairs ``a < b`` of ``rid`` whose ``tokens`` (distinct, not empty) overlap in ``threshold`` or more.

    ``sets`` is (rid LONG unique, tokens ARRAY<LONG> sorted); it is read several times, so it should be a written table or cheap to make from one.
    ``list_length`` is the expected length at which a signature takes one more token.
    """
    if not 0.5 <= threshold <= 1:
        raise ValueError("the threshold must lie in [0.5, 1]")
    spark = sets.sparkSession
    order, n = _order(sets, list_length)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = blocks or max(parts, math.ceil(n * 50 / 2_000_000))
    hot, dealt = _foreseen(sets, order, threshold, n, hot_list)
    # both of bounded size: see SKETCH_BITS, MOST_FREQUENT, _foreseen
    shared = spark.sparkContext.broadcast((order, hot, dealt))

    def blocks_of(batches):
        yield from _blocks(shared.value[0], threshold, buckets, shared.value[1])(batches)

    def hot_of(batches):
        yield from _hot_blocks(shared.value[0], threshold, *shared.value[1:])(batches)

    packed = sets.mapInArrow(blocks_of, BLOCK).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    candidates = packed.mapInArrow(_lists(threshold), "a long, b long")
    if len(hot):
        rows = sets.mapInArrow(hot_of, "sig long, block int, blocks int, packed binary").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = rows.select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "packed")
        met = met.repartition(max(parts, int((dealt * (dealt + 1) // 2).sum())), "sig", "i", "j").sortWithinPartitions("sig", "i", "j")
        candidates = candidates.unionByName(met.mapInArrow(_meet(threshold), "a long, b long"))
    # written, so that the packed blocks are free before the words are moved
    candidates = written(candidates.distinct(), "candidates")
    left = sets.select(F.col("rid").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("rid").alias("b"), F.col("tokens").alias("tb"))
    shares = F.size(F.array_intersect("ta", "tb"))
    every = F.size("ta") + F.size("tb") - shares
    return candidates.join(left, "a").join(right, "b").where(shares >= F.lit(threshold) * every - 1e-9).select("a", "b")


def token_sets(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """A written table (key, tokens, h, row): each record's words as sorted hashes, without records that have no word or no
    key. Rows that repeat a key and its words stay."""
    base = (
        df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), tokens_of(words_of(*[F.col(c) for c in columns])).alias("tokens"))
        .where(F.size("tokens") > 0).withColumn("h", F.xxhash64("tokens")).withColumn("row", F.monotonically_increasing_id())
    )
    return written(base, "tokens")


def near_duplicates(df: DataFrame, key: str, *columns: str, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Links and classes of near-duplicate records.

    Returns ``(links, members)``, of one form whatever the sizes of classes. ``members`` is (key, rid): the records by class
    of equal word sets, ``rid`` being the least key of the class. ``links`` is (a, b), a < b, distinct: the pairs of classes
    of near-duplicate but different word sets, by ``rid``. ``expanded`` makes pairs of records of the two.

    Defined cases: a NULL text counts as empty; records without any word are near-duplicates of nothing; a NULL key
    stays out; rows that repeat a key count once (they are taken to repeat its text); an empty table gives no rows;
    other columns are ignored.
    """
    base = token_sets(df, key, *columns)
    rows = base.select("row", "key", "h", F.size("tokens").alias("n"), F.hash("tokens").alias("h2"))
    first = F.min(F.struct("key", "row"))
    classes = rows.groupBy("h", "n", "h2").agg(first.alias("f")).select("h", "n", "h2", F.col("f.key").alias("rid"), F.col("f.row").alias("first"))
    placed = written(rows.join(classes, ["h", "n", "h2"]).select("row", "key", "rid", "first"), "members")
    members = placed.select("key", "rid").distinct()
    copies = placed.where(F.col("row") != F.col("first")).select("row")
    # only the first row of each class goes on; where copies are few, they are sent to all tasks instead of moving (and writing) the sets
    few = copies.count() <= FEW_COPIES
    reps = base.join(F.broadcast(copies) if few else copies, "row", "left_anti").select(F.col("key").alias("rid"), "tokens")
    return similar_sets(reps if few else written(reps, "sets"), threshold), members


def expanded(links: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of near-duplicate records: those inside classes and those of linked classes. As many rows as
    there are such pairs, so classes of very many copies are better left as they are."""
    across = links.join(members.select(F.col("rid").alias("a"), F.col("key").alias("x")), "a").join(members.select(F.col("rid").alias("b"), F.col("key").alias("y")), "b").select("x", "y")
    copied = members.join(members.where("key <> rid").select("rid").distinct(), "rid", "left_semi")
    inside = copied.select("rid", F.col("key").alias("x")).join(copied.select("rid", F.col("key").alias("y")), "rid").where("x < y").select("x", "y")
    return across.unionByName(inside).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of undirected ``edges`` (a, b), root being the least node.

    Alternates linking each node's larger neighbours, then all neighbours, to the least one, until nothing changes, which
    takes about as many rounds as the logarithm of the longest path. Each round is written to the shared folder; no star is collected anywhere.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        now = written(small, "small")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
