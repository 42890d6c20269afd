import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from bidweave.llm import similar

WORD = re.compile("[a-z0-9]+")


def brute(rows, t):
    sets = {}
    for seq, s, q in rows:
        if seq is not None and (words := set(WORD.findall(f"{s or ''} {q or ''}".lower()))):
            sets[seq] = words
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def corpus(seed, n=160):
    r = random.Random(seed)
    common, rare = [f"c{k}" for k in range(14)], [f"r{k}" for k in range(120)]
    out = []
    for k in range(n):
        if out and r.random() < 0.6:
            words = list(WORD.findall(f"{r.choice(out)[1]}"))
            for _ in range(r.randint(0, max(1, len(words) // 4))):
                if words and r.random() < 0.5:
                    words.pop(r.randrange(len(words)))
                else:
                    words.insert(r.randrange(len(words) + 1), r.choice(rare))
        else:
            words = r.sample(common, r.randint(1, 9)) + r.sample(rare, r.randint(0, 9))
        out.append((k, " ".join(words), ""))
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("t", [0.7, 0.85])
def test_all_pairs_are_found(spark, seed, t):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "seq long, statement string, quote string")
    pairs = similar.expanded(*similar.near_duplicates(df, "seq", "statement", "quote", threshold=t))
    assert set(map(tuple, pairs.collect())) == brute(rows, t)


@pytest.mark.parametrize("list_length,hot", [(1, 20000), (4, 20000), (40, 3)])
def test_classes_of_tokens_and_hot_lists_lose_nothing(spark, list_length, hot):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "seq long, statement string, quote string")
    sets = similar.token_sets(df, "seq", "statement", "quote").groupBy("tokens").agg(F.min("key").alias("rid")).select("rid", "tokens")
    sets = similar.written(sets, "sets")
    firsts = {r["rid"] for r in sets.collect()}
    got = set(map(tuple, similar.similar_sets(sets, 0.7, list_length, hot).collect()))
    assert got == {(a, b) for a, b in brute(rows, 0.7) if a in firsts and b in firsts}


def test_edge_cases(spark):
    rows = [
        (1, None, None), (2, "", "  ... "), (3, "One Two", None), (4, None, "two ONE"), (3, "One Two", None), (None, "one", "two"), (5, "one", "two three"), (6, "x " * 5000, "y"), (7, "x", "y y"), (8, "ÉTÉ 1", ""),
    ]
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], "seq long, statement string, quote string, key string, rid int")
    links, members = similar.near_duplicates(df, "seq", "statement", "quote", threshold=0.66)
    assert sorted(map(tuple, links.collect())) == [(3, 5)]
    assert sorted(map(tuple, similar.expanded(links, members).collect())) == [(3, 4), (3, 5), (4, 5), (6, 7)]
    assert sorted(map(tuple, members.collect())) == [(3, 3), (4, 3), (5, 5), (6, 6), (7, 6), (8, 8)]
    none, _ = similar.near_duplicates(df.limit(0), "seq", "statement", "quote")
    assert none.collect() == []


def test_large_classes_have_the_same_form(spark):
    rows = [(k, "same words here", "") for k in range(1200)] + [(5000, "same words here now", "")]
    df = spark.createDataFrame(rows, "seq long, statement string, quote string")
    links, members = similar.near_duplicates(df, "seq", "statement", "quote", threshold=0.7)
    assert list(map(tuple, links.collect())) == [(0, 5000)] and members.where("rid = 0").count() == 1200
    assert similar.expanded(links, members).count() == 1200 * 1199 // 2 + 1200


def test_no_task_holds_a_hot_list(spark):
    """One combination of frequent words in 30,000 records, with a few near-duplicates among them."""
    n, least = 30_000, 1000
    rows = [(k, "alpha beta gamma delta epsilon zeta eta theta iota kappa " + " ".join(f"{c}{k}" for c in "abc")) for k in range(n)]
    rows += [(n + k, rows[k * 700][1] + " more") for k in range(20)]
    sets = spark.createDataFrame(rows, "rid long, t string").select("rid", similar.tokens_of(similar.words_of(F.col("t"))).alias("tokens"))
    sets = similar.written(sets.repartition(8), "sets")
    order, total = similar._order(sets, 1)
    order.phrase[:] = False
    order.single, order.pair = 0, 0  # words of any frequency only in threes
    hot, blocks = similar._foreseen(sets, order, 0.7, total, least)
    assert len(hot) and blocks.max() >= n // least
    packed = sets.mapInArrow(similar._hot_blocks(order, 0.7, hot, blocks), "sig long, block int, blocks int, packed binary")
    size = F.length("packed") / (8 * (3 + similar.SKETCH_WORDS))
    held = packed.groupBy("sig", "block").agg(F.sum(size).alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert held[0] < 1.3 * least and held[1] >= n
    got = set(map(tuple, similar.similar_sets(sets, 0.7, 2000, least).collect()))
    assert got == {(k * 700, n + k) for k in range(20)}


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (200, 201), (201, 202), (202, 200), (7, 7)]
    got = dict(map(tuple, similar.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in (100, 101, 103)} == {100} and {got[k] for k in (200, 201, 202)} == {200}
    assert similar.components(spark.createDataFrame([], "a long, b long")).collect() == []
