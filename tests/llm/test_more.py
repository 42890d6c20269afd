"""Personal details, pieces, leaks, mixtures."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bidweave.llm import catalog, leaks, mixing, pieces, pii
from bidweave.llm.pii_labels import LABELS, labelled


def test_held_out_accuracy():
    model, hit, made, there = pii.tagger(), np.zeros(6), np.zeros(6), np.zeros(6)
    data = [pii._labels(p) for p in labelled(500, seed=987)]
    for (_, gold), got in zip(data, model.tag([t for t, _ in data])):
        got = np.zeros(len(gold), int) if got is None else got
        for k in range(1, len(LABELS)):
            g, m = np.array(gold) == k, got == k
            hit[k] += (g & m).sum()
            made[k] += m.sum()
            there[k] += g.sum()
    assert (hit[1:] / made[1:]).min() > 0.96 and (hit[1:] / there[1:]).min() > 0.95


def test_bound_rules_out_nothing():
    model = pii.tagger()
    texts = ["".join(t for t, _ in p) for p in labelled(120, seed=55)]
    score, begin = model.scores(texts)
    for i, got in enumerate(model.tag(texts)):
        if begin[i + 1] > begin[i]:
            full = model._viterbi(score, begin, np.array([i]))[0]
            assert np.array_equal(full, got if got is not None else np.zeros(len(full)))


DETAILS = {
    "Attn: Carla G. Fogud; call (512) 555-0103.": ("Attn: [name]; call [phone].", 2),
    "Write to jastegi_amos [at] hq.nornno.example.org, bearer of badge number A272691.": ("Write to [email], bearer of badge number [id_number].", 2),
    "Deliver to 2526 S.E. Gogrend Street, Fialbrem, XK 00979.": ("Deliver to [address].", 1),
    "See the Jucknoult Street signs and stock number 1804-01-555-9016.": (None, 0),
    "The vendor shall report to the program manager.": (None, 0),
}


@pytest.mark.parametrize("text,want", DETAILS.items())
def test_redaction(text, want):
    labels = pii.tagger().tag([text])[0]
    found = pii.spans(text, labels) if labels is not None else []
    assert len(found) == want[1]
    if want[0]:
        assert pii.redacted(text, found) == want[0]


def test_details_frame(spark):
    rows = [(1, "Contact Mrs. Gogrend at mei@hq.test", None), (2, None, ""), (3, "", "ＳＳＮ　666-26-2607 of Kofi Skaeskjei"), (None, "Contact Mrs. Gogrend", ""), (4, "word " * 30000 + "mobile 2125550136.", "none")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "seq long, statement string, quote string, key string")
    got = {(r["key"], r["field"]): r for r in pii.details(df, "seq", ["statement", "quote"]).collect()}
    assert got[1, "statement"]["redacted"] == "Contact [name] at [email]" and got[4, "statement"]["types"] == ["phone"]
    assert "id_number" in got[3, "quote"]["types"] and set(got) == {(1, "statement"), (3, "quote"), (4, "statement")}
    for k, r in got.items():  # all else is unchanged
        text = dict((x[0], x) for x in rows)[k[0]][1 if k[1] == "statement" else 2]
        rest, at = [], 0
        for s in r["spans"]:
            rest.append(text[at : s["begin"]])
            at = s["end"]
        kept = r["redacted"]
        for part in [*rest, text[at:]]:
            assert part in kept
    assert pii.details(df.limit(0), "seq", ["quote"]).collect() == []


def rejoined(rows, overlap):
    rows = sorted(rows, key=lambda r: r["piece"])
    for a, b in itertools.pairwise(rows):
        assert b["text"][:overlap] == a["text"][-overlap:]
    return rows[0]["text"] + "".join(r["text"][overlap:] for r in rows[1:])


@pytest.mark.parametrize("size", [400, 1000, 32768])
def test_pieces_round_trip(spark, size):
    r = random.Random(size)
    texts = {k: " ".join("wörd" * r.randint(1, 3) + r.choice(["", ".", "\n\n", ";"]) for _ in range(n)) for k, n in enumerate([40, 200, 900, 2500])}
    texts |= {10: "x" * 5000, 11: " " * 3000 + "short" + "\n" * 3000, 12: "  " + "a b. " * 500 + " ", 13: "é" * 1001, 14: "é" * 1000}
    rows = [("t", k, v, 1) for k, v in texts.items()] + [("t", 1, texts[1], 1), ("t", 50, None, 1), ("t", None, "y" * 5000, 1), ("u", 10, "z" * 3000, 1)]
    df = spark.createDataFrame(rows, "kind string, id long, text string, piece int")
    got: dict = {}
    for x in pieces.split_texts(df, limit=1000, overlap=50, size=size).collect():
        got.setdefault((x["kind"], x["id"]), []).append(x)
    want = {("t", k): v.strip() for k, v in texts.items() if len(v.strip()) > 1000} | {("u", 10): "z" * 3000}
    assert set(got) == set(want)
    for k, rows in got.items():
        assert max(len(x["text"]) for x in rows) <= 1000 and rejoined(rows, 50) == want[k]


def test_pieces_break_where_the_text_does():
    text = "One sentence here. Another one\n\nA new paragraph begins. And goes on and on"
    assert pieces.best_cut(text, 5, 60) == (text.index("A new"), 1)
    assert pieces.best_cut(text, 5, 25)[1] == 2 and pieces.best_cut("a" * 50, 5, 25) == (25, 5)


def test_file_ranges(spark, tmp_path):
    path = tmp_path / "big.txt"
    text = "".join(f"Zeile {k}: größer als vorher – gewiss.\n" for k in range(3000))
    path.write_text(text, encoding="utf-8")
    files = pieces.listed(spark, str(tmp_path))
    assert files.first()["bytes"] == path.stat().st_size
    ranges = pieces.file_ranges(files, limit=1000, overlap=50, size=5000)
    got = pieces.emit(ranges, pieces.piece_offsets(ranges, 1000, 50)).collect()
    assert rejoined(got, 50) == text and max(len(r["text"]) for r in got) <= 1000


def edit_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=20))
def test_myers(p, t):
    assert leaks.myers(p, t) == edit_distance(p, t)


def test_leaks_by_brute_force(spark):
    r = random.Random(8)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(r.choices(vocab, k=r.randint(5, 40)))) for k in range(25)]
    docs = []
    for k in range(120):
        words = r.choices(vocab, k=r.randint(0, 80))
        if r.random() < 0.6:
            source = r.choice(items)[1].split()
            a = r.randint(0, max(0, len(source) - 13))
            at = r.randint(0, len(words))
            words[at:at] = source[a : a + r.randint(8, 40)]
            if r.random() < 0.5:
                words[min(len(words) - 1, at + 3)] = "changed"
        docs.append((k, ", ".join(words).upper() if k % 2 else "\n".join(words)))
    docs += [(900, None), (901, ""), (None, items[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("line", F.lit("clash"))
    i = spark.createDataFrame([*items, (70, None), (71, "")], "item_id long, text string")
    grams = lambda t: {tuple(w[k : k + 12]) for w in [t.lower().replace(",", " ").split()] for k in range(len(w) - 11)}
    want = {(a, b) for a, x in docs if x and a is not None for b, y in items if grams(x) & grams(y)}
    budget = lambda w: len(leaks.pieces_of(w)) - 1
    split = lambda t: t.lower().replace(",", " ").split()
    whole = {(a, b) for a, x in docs[:40] + docs[120:] if x and a is not None for b, y in items if edit_distance(y.split(), split(x)) <= budget(y.split())}
    d = d.where("doc_id < 40 OR doc_id >= 120 OR doc_id IS NULL")
    want = {(a, b) for a, b in want if a < 40 or a >= 120}
    for most in (leaks.BROADCAST_CHARS, 0):
        got = leaks.leaks(d, i, broadcast_chars=most)
        rows = got.collect()
        assert {(x["doc_id"], x["item_id"]) for x in rows if x["passage_distance"] == 0} == want == {(x["doc_id"], x["item_id"]) for x in rows if x["longest_run"] >= leaks.RUN}
        # the whole item within its errors, against all pairs
        assert {(x["doc_id"], x["item_id"]) for x in rows if x["edit_distance"] <= x["error_budget"]} == whole
    assert leaks.leaks(d.limit(0), i).collect() == []


def test_whole_item_with_errors(spark):
    item = " ".join(f"k{n}" for n in range(30))
    changed = item.replace("k5 ", "other ").replace("k14 ", "").replace("k22", "k22 extra")
    d = spark.createDataFrame([(1, f"before {changed} after")], "doc_id long, text string")
    got = leaks.leaks(d, spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert got["edit_distance"] == 3 <= got["error_budget"] and got["longest_run"] < leaks.RUN


@settings(max_examples=200, deadline=None)
@given(st.floats(0, 1000), st.lists(st.tuples(st.floats(0, 5), st.floats(0, 300)), max_size=8))
def test_fill(amount, children):
    got = mixing.fill(amount, children)
    able = sum(c for w, c in children if w > 0)
    assert sum(got) == pytest.approx(min(amount, able), abs=1e-6)
    assert all(-1e-9 <= g <= c + 1e-6 for g, (_, c) in zip(got, children))


def test_shortage_goes_to_siblings_first():
    leaf = lambda d, s, w, c: {"domain": d, "language": "en", "source": s, "weight": w, "capacity": c}
    leaves = [leaf("x", "a", 0.25, 10.0), leaf("x", "b", 0.25, 1000.0), leaf("y", "c", 0.5, 1000.0)]
    assert mixing.budgets(leaves, 100) == pytest.approx([10, 40, 50])
    leaves[1]["capacity"] = 20.0
    assert mixing.budgets(leaves, 100) == pytest.approx([10, 20, 70])


def test_mixture(spark):
    rows = [(k, "word " * 20, s, lang, t) for k, (s, lang, t) in enumerate([("a", "en", "Notice")] * 40 + [("b", "EN-US", None)] * 20 + [("c", None, "Re: x")] * 3 + [("d", "en", "")] * 5 + [(None, "en", "t")] * 2)]
    rows += [(900, None, "a", "en", "t"), (901, "", "a", "en", "t"), (None, "word", "a", "en", "t")]
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, source string, lang string, title string, domain string, tokens int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("e", None, 3), ("f", 0.1, None)], "source string, target_share double, max_repeats int")
    mixture, shares = mixing.mix(docs, targets, vocabulary=catalog.VOCABULARY)
    uses = mixture.collect()
    most = {"a": 1, "b": 2, "c": 4}
    assert len({r["doc_id"] for r in uses}) == len(uses) and all(0 < r["uses"] <= most[r["source"]] for r in uses)
    got = {r["source"]: r for r in shares.collect()}
    assert set(got) == {"a", "b", "c", "e", "f"} and got["c"]["reached_tokens"] == 12 * got["c"]["available_tokens"] // 3 and not got["c"]["reached_target"]
    assert sum(r["reached_share"] for r in got.values()) == pytest.approx(1)
    again, _ = mixing.mix(docs, targets, vocabulary=catalog.VOCABULARY)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, uses))
    small, part = mixing.mix(docs, targets, budget=400, vocabulary=catalog.VOCABULARY)
    assert abs(sum(r["reached_tokens"] for r in part.collect()) - 400) < 90
    none, empty = mixing.mix(docs.limit(0), targets, vocabulary=catalog.VOCABULARY)
    assert none.collect() == [] and {r["reached_share"] for r in empty.collect()} == {0.0}


def test_very_long_values_and_kinds_of_names():
    tagger = pii.tagger()
    long = "word " * 120_000 + "write to pat.quill@example.gov"
    short = ["Attn: Robert Hall will call.", "nothing here", long, "Mail jo.doe@example.org today"]
    tags = tagger.tag([pii._readable(t)[0] for t in short])
    found = [{k for *_, k in pii.spans(t, x)} if x is not None else set() for t, x in zip(short, tags)]
    assert found[1] == set() and found[2] == {"email"} and "email" in found[3]
    assert pii._sound("name", "robert hall", "") and pii._sound("name", "Lane", "Ask Ms. ") and not pii._sound("name", "Wixom Hall", "") and not pii._sound("name", "Robert Foundation", "")
