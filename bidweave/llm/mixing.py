"""A mixture of sources by target weights, with capped repetition.

Weights hang on the leaves of a tree domain - language - source. A leaf's weight is its source's target share, divided
over the source's domains and languages as its tokens are. The budget flows down the tree: a node hands its amount to
its children by weight, no child getting more than its documents can give with the repetitions allowed; what a child
can't take goes to its siblings first, and only what a whole subtree can't take goes up to its parent's other subtrees.

Each leaf then takes whole epochs and a prefix of one more epoch of its documents in an order given by a seed. The prefix
is found from token sums of hash ranges, so a source that holds a third of all documents is never ordered in one task.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidweave.session import written

# Fixed value: the pattern that splits text before the merges of these ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEVELS = ("domain", "language", "source")
#: Documents in one hash range of a leaf, about; only inside one range are documents put in order.
RANGE = 2_000


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str = "text", *, vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """``df`` with ``text`` replaced by ``tokens``, its length in the tokenizer's tokens (0 for NULL)."""
    keep = [f for f in df.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoding(vocabulary, pattern).encode_ordinary
        for batch in batches:
            n = pa.array([len(count(t)) if t else 0 for t in batch.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), n], names=[*(f.name for f in keep), "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", tokens long"
    return df.mapInArrow(run, schema)


def language(lang: Column) -> Column:
    """A language code in one form: ``EN`` and ``en-XX`` are ``en``, none is ``und``."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(lang, r"^\s*([A-Za-z]{2,3})", 1)), F.lit("")), F.lit("und"))


def fill(amount: float, children: list[tuple[float, float]]) -> list[float]:
    """``amount`` handed to ``children`` (weight, capacity) by weight, what one can't take going to the others."""
    got, open_ = [0.0] * len(children), [i for i, (w, c) in enumerate(children) if w > 0 and c > 0]
    left = amount
    while open_ and left > 1e-9:
        total = sum(children[i][0] for i in open_)
        full = [i for i in open_ if left * children[i][0] / total >= children[i][1] - got[i] - 1e-9]
        if not full:
            for i in open_:
                got[i] += left * children[i][0] / total
            return got
        for i in full:
            left -= children[i][1] - got[i]
            got[i] = children[i][1]
        open_ = [i for i in open_ if i not in full]
    return got


def budgets(leaves: list[dict], budget: float) -> list[float]:
    """The amount of each leaf; a leaf is a dict of ``LEVELS``, ``weight`` and ``capacity``."""
    out = [0.0] * len(leaves)

    def down(members: list[int], depth: int, amount: float) -> None:
        if depth == len(LEVELS):
            for i, a in zip(members, fill(amount, [(leaves[i]["weight"], leaves[i]["capacity"]) for i in members])):
                out[i] = a
            return
        groups: dict = {}
        for i in members:
            groups.setdefault(leaves[i][LEVELS[depth]], []).append(i)
        parts = fill(amount, [(sum(leaves[i]["weight"] for i in g), sum(leaves[i]["capacity"] for i in g)) for g in groups.values()])
        for g, a in zip(groups.values(), parts):
            down(g, depth + 1, a)

    down(list(range(len(leaves))), 0, budget)
    return out


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7, *, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    """``(mixture, shares)``.

    ``docs`` is (doc_id, text, source, lang, domain), ``doc_id`` unique, ``domain`` being whatever the caller groups by (it may
    be left out); ``targets`` is (source, target_share,
    max_repeats), ``source`` unique, a table as small as its number of sources. ``budget`` is the mixture's size in tokens, by
    default that of all documents of targeted sources.

    ``vocabulary`` is the path, the same for all workers, of a file of merge ranks of a byte-level tokenizer.

    ``mixture`` is (doc_id, source, tokens, uses): each document that is used, how often (never more than its source's
    ``max_repeats``). ``shares`` is (source, target_share, max_repeats, documents, available_tokens, target_tokens,
    reached_tokens, reached_share, reached_target) for every targeted source, also those without documents.

    NULL texts have no tokens and aren't used; documents of a NULL or untargeted source, and NULL ids, stay out; NULL
    language and domain count as ones of their own; a NULL or non-positive share or repeat count asks
    for nothing; ties in the seeded order are cut by the id; other columns are ignored; empty tables give no mixture.
    """
    want = targets.where("source IS NOT NULL").select("source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    sized = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "source", language(F.col("lang")).alias("language"),
        (F.coalesce(F.col("domain").cast("string"), F.lit("")) if "domain" in docs.columns else F.lit("")).alias("domain"))
    sized = token_counts(sized.join(want.select("source"), "source", "left_semi"), vocabulary=vocabulary).where("tokens > 0")
    sized = written(sized.withColumn("place", F.xxhash64(F.lit(seed), "doc_id")), "sized")
    # one row a leaf: as many as there are sources, languages and kinds
    held = sized.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).join(want, "source").collect()
    of_source: dict[str, int] = {}
    for r in held:
        of_source[r["source"]] = of_source.get(r["source"], 0) + r["tokens"]
    leaves = [{k: r[k] for k in LEVELS} | {
        "weight": r["target_share"] * r["tokens"] / of_source[r["source"]], "capacity": float(r["tokens"] * r["max_repeats"]), "tokens": r["tokens"], "n": r["n"], "max": r["max_repeats"]} for r in held]
    size = budget if budget is not None else sum(x["tokens"] for x in leaves)
    rows = []
    for leaf, amount in zip(leaves, budgets(leaves, size)):
        epochs = min(int(amount // leaf["tokens"]), leaf["max"])
        rest = amount - epochs * leaf["tokens"] if epochs < leaf["max"] else 0.0
        rows.append((*(leaf[k] for k in LEVELS), epochs, float(rest), max(1, math.ceil(leaf["n"] / RANGE))))
    spark = docs.sparkSession
    plan = spark.createDataFrame(rows, "domain string, language string, source string, epochs int, rest double, ranges int")
    placed = sized.join(plan, list(LEVELS)).withColumn("range", F.pmod(F.shiftrightunsigned("place", 20), F.col("ranges")))
    sums = placed.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("sum"))
    # a leaf has one range for about RANGE documents: these sums are small, and inside a range only its own documents are ordered
    before = F.coalesce(F.sum("sum").over(Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.join(sums.withColumn("before", before).drop("sum"), [*LEVELS, "range"])
    edge = (F.col("rest") > F.col("before"))
    order = Window.partitionBy(*LEVELS, "range").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("before") + F.coalesce(F.sum("tokens").over(order), F.lit(0)) + F.col("tokens") / 2
    mixture = placed.withColumn("more", F.when(edge & (upto <= F.col("rest")), 1).otherwise(0)).select(
        "doc_id", "source", "tokens", (F.col("epochs") + F.col("more")).cast("int").alias("uses")).where("uses > 0")
    mixture = written(mixture, "mixture")
    used = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("reached_tokens"))
    there = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available_tokens"))
    total = F.sum("reached_tokens").over(Window.partitionBy())  # over one row for each targeted source
    shares = want.join(there, "source", "left").join(used, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("documents", "available_tokens", "reached_tokens")})
    shares = shares.select(
        "source", "target_share", "max_repeats", "documents", "available_tokens", (F.col("target_share") * F.lit(float(size))).alias("target_tokens"), "reached_tokens",
        F.coalesce(F.try_divide(F.col("reached_tokens"), total), F.lit(0.0)).alias("reached_share"))
    return mixture, shares.withColumn("reached_target", F.col("reached_share") >= F.col("target_share") - 0.005)
