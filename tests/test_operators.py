from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidweave.functions import constants as K
from bidweave.operators import facts, items, keyword, pages, quotes, redaction, replies, reports, scoring
from bidweave.sources import files, tables

ITEM = (
    "package_id string, seq long, kind string, statement string, quote string, page int, document string, role string, date string, time string, weight string, "
    "verification string, similarity double, cited_page int, end_page int, also_on array<int>, superseded_by string, warnings array<string>"
)


def item(seq, kind, statement, quote, page=1, document="d", role="base", date="", time="", weight="", package="p", verification="exact", superseded=None):
    return (package, seq, kind, statement, quote, page, document, role, date, time, weight, verification, 1.0, page, None, [], superseded, [])


def frame(spark, rows):
    return spark.createDataFrame(rows, ITEM)


def test_latest_record(spark):
    df = spark.createDataFrame([(1, "a", "2024-01-01"), (1, "a", None), (1, "b", "2024-02-01"), (None, "c", "2024-01-01"), (2, "d", None)], "k int, v string, loaded_at string")
    assert sorted((r["k"], r["v"]) for r in tables.latest(df, "k").collect()) == [(1, "b"), (2, "d")]


def test_page_split_and_pairing(spark):
    df = spark.createDataFrame([("d", "one\ftwo\fthree\f"), ("e", "only"), ("f", ""), ("g", None)], "doc_id string, text string")
    got = sorted((r["doc_id"], r["page"], r["text"]) for r in pages.split_pages(df).collect())
    assert got == [("d", 1, "one"), ("d", 2, "two"), ("d", 3, "three"), ("e", 1, "only")]
    layout = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b"), ("e", 1, "x")], "doc_id string, page int, text string")
    reading = spark.createDataFrame([("d", 1, "A"), ("d", 2, "B"), ("e", 1, "X"), ("e", 2, "Y")], "doc_id string, page int, text string")
    assert sorted((r["doc_id"], r["page"], r["reading"]) for r in pages.pair_renderings(layout, reading).collect()) == [("d", 1, "A"), ("d", 2, "B"), ("e", 1, "")]


def packed(lengths, limit):
    out, cur, size = [], [], 0
    for n, k in enumerate(lengths, 1):
        if not k:
            continue
        if cur and size + k + 20 > limit:
            out, cur, size = out + [cur], [], 0
        cur.append(n)
        size += k + 20
    return out + [cur] if cur else out


@pytest.mark.parametrize("lengths", [[4000] * 5, [10, 0, 9000, 5, 20000, 1], [], [0, 0], [8980, 1], [8960, 1]])
def test_chunk_packing(spark, lengths):
    df = spark.createDataFrame([("d", n, "x" * k) for n, k in enumerate(lengths, 1)] or [("e", 1, " ")], "doc_id string, page int, text string")
    got = [r["pages"] for r in pages.pack_pages(df).orderBy("chunk_idx").collect()]
    assert got == packed(lengths, K.CHUNK_CHARS)


def test_blank_pages_and_chunk_text(spark):
    df = spark.createDataFrame([("d", 1, " \n"), ("d", 2, "y" * 50), ("d", 3, None)], "doc_id string, page int, text string")
    assert pages.blank_pages(df).collect()[0]["blank"] == [1, 3]
    assert pages.chunk_texts(df).collect()[0]["text"] == "<<<PAGE 2>>>\n" + "y" * 50


PAGES = [
    ("d", 1, "General terms of the offer and nothing else is said on this first page.", ""),
    ("d", 2, "The vendor shall deliver the approach/solu-\ntion within thirty days of the award notice.\n\n5", ""),
    ("d", 3, "continues here with further duties of every vendor who signs the agreement.", ""),
    ("d", 4, "Rate Table\nAlpha widget 12 Beta gadget 14\nGamma sprocket unit price per month", ""),
    ("d", 5, "left column words mixed right column", "the straight reading order of both columns stands here"),
]


def test_locate(spark):
    p = spark.createDataFrame(PAGES, "doc_id string, page int, text string, reading string")
    cases = {
        1: ("deliver the approach/solution within thirty days", 2, ("exact", 2, 1.0, None)),
        2: ("deliver the approach/solution within thirty days", 1, ("exact", 2, 1.0, None)),
        3: ("thirty days of the award notice. continues here with further", 2, ("exact", 2, 1.0, 3)),
        4: ("the straight reading order of both columns", None, ("exact", 5, 1.0, None)),
        5: ("further duties of every vendor who signs agreement", 3, ("fuzzy", 3, None, None)),
        6: ("month price gadget sprocket Alpha 14 widget Beta", 4, ("assembled", 4, None, None)),
        7: ("an invented sentence about submarines and volcanoes in space", 1, ("missing", None, None, None)),
        8: ("short", 1, ("missing", None, 0.0, None)),
        9: (None, 1, ("missing", None, 0.0, None)),
    }
    i = spark.createDataFrame([(k, "d", q, c) for k, (q, c, _) in cases.items()] + [(10, "none", "a quote of a document that has no pages", 1)], "seq long, document string, quote string, page int")
    got = {r["seq"]: r for r in quotes.locate(i, p).collect()}
    assert len(got) == 10 and got[10]["status"] == "missing"
    for k, (_, _, (status, page, sim, end)) in cases.items():
        r = got[k]
        assert (r["status"], r["page"], r["end_page"]) == (status, page, end), k
        assert sim is None or r["similarity"] == sim


def test_window_ratio_is_exact():
    page = ("the vendor shall deliver the goods to the site and the vendor shall report to the office each month of the term " * 3).split()
    for quote in ("the vendor shall deliver goods to site", "vendor reports to the office each month", "nothing alike whatever"):
        q = quote.split()
        n, best = len(q), 0.0
        for i, w in enumerate(page):
            if w in set(q[:4]):
                for size in (max(1, int(n * 0.85)), n, int(n * 1.15) + 1):
                    best = max(best, SequenceMatcher(None, " ".join(q), " ".join(page[i : i + size]), autojunk=False).ratio())
        assert quotes.window_ratio(q, page) == pytest.approx(best)
        assert quotes.window_ratio(q, page, 0.9) == pytest.approx(best if best >= 0.9 else 0.0)


def test_ratio_beyond_a_floor():
    import random

    r = random.Random(4)
    for _ in range(300):
        a = "".join(r.choices("abc d", k=r.randint(0, 40)))
        b = "".join(r.choices("abc d", k=r.randint(0, 40))) if r.random() < 0.5 else a[:10] + "x" + a[12:]
        true, least = SequenceMatcher(None, a, b, autojunk=False).ratio(), r.random()
        got = quotes.ratio_beyond(a, b, least)
        assert got == pytest.approx(true) if true > least else got <= least


def test_blocks_of_parts_of_a_text_are_kept():
    import random

    r = random.Random(7)
    for _ in range(60):
        a, b = ("".join(r.choices("abcd ", k=n)) for n in (30, 90))
        known, runs = {}, quotes._runs(a, b)
        for lo in range(0, 60, 7):
            for hi in (lo, lo + 25, lo + 30):
                true = SequenceMatcher(None, a, b[lo:hi], autojunk=False).ratio()
                assert quotes.ratio_beyond(a, b, -1.0, lo, hi, known, runs) == true
        windows = [b[n : n + 30] for n in range(0, 60, 9)] + ["", "x"]
        apart = [next(iter(quotes._common(a, [w]))) for w in windows]
        assert quotes._common(a, windows).tolist() == apart


def test_locate_of_a_crowded_document(spark, monkeypatch):
    p = spark.createDataFrame(PAGES, "doc_id string, page int, text string, reading string")
    rows = [(n, "d", q, c) for n, (q, c) in enumerate([("deliver the approach/solution within thirty days", 1), ("thirty days of the award notice. continues here with further", 2), ("further duties of every vendor who signs agreement", 3), ("short", 1)] * 3)]
    i = spark.createDataFrame([*rows, (99, None, "a quote that has no document at all", None)], "seq long, document string, quote string, page int")
    alone = sorted(map(tuple, quotes.locate(i, p).collect()), key=lambda r: r[0])
    monkeypatch.setattr(quotes, "CROWD", 2)
    assert sorted(map(tuple, quotes.locate(i, p).collect()), key=lambda r: r[0]) == alone
    assert [r[1:3] for r in alone[:4]] == [("exact", 2), ("exact", 2), ("fuzzy", 3), ("missing", None)] and alone[-1][:2] == (99, "missing")


def test_trimmed_is_strip_footer(spark):
    from bidweave.functions.text import strip_footer

    texts = ["a\nb\n 3 \n\n", "a\nPage 3 of 9\r", "a\n12\u2028", "Page 1", "", "x\nThe page 12", "a\n\x1c", "a\u3000\n\u00a0\n7", "a\n1234", "a\r\n 5\r\n"]
    got = spark.createDataFrame(list(enumerate(texts)), "n int, t string").orderBy("n").select(strip_footer(F.col("t")).alias("t")).collect()
    assert [quotes._trimmed(t) for t in texts] == [r["t"] for r in got]


def test_covering():
    assert quotes.covering({"a", "b"}, "a x x b a".split()) == 2
    assert quotes.covering({"a", "z"}, "a b".split()) is None


def test_coerce(spark):
    reply = [
        'Sure: {"items":[{"kind":"naics","statement":" s ","quote":"q","page":4,"date":"","time":"","weight":""},{"kind":"none","quote":"q"},{"kind":"naics","quote":"  "}]} done',
        '```json\n{"items":[{"kind":"naics","quote":"q","page":"x"}]}\n```', '{"kind":"naics","quote":"a"} {"kind":"naics","quote":"b"}', "no object", None, '{"items":[]}',
    ]
    df = spark.createDataFrame(list(enumerate(reply)), "id int, reply string")
    got = sorted((r["id"], r["idx"], r["quote"], r["page"], r["statement"]) for r in items.coerce(df).collect())
    assert got == [(0, 0, "q", 4, "s"), (1, 0, "q", None, ""), (2, 0, "a", None, ""), (2, 1, "b", None, "")]


def test_reclassify(spark):
    rows = [
        item(1, "response_due", "Submit questions by then", "q", date="2026-01-01"), item(2, "response_due", "Proposals are due; questions later", "q", date="2026-01-01"), item(3, "response_due", "Late bids", "q"),
        item(4, "required_content", "The NAICS code is 541512", "q"), item(5, "required_content", "required NAICS", "q"), item(6, "registration", "A small business set-aside", "q"), item(7, "evaluation_factor", "Meet the goals", "q"), item(8, "conference", None, "q"),
    ]
    got = [r["kind"] for r in items.reclassify(frame(spark, rows)).orderBy("seq").collect()]
    assert got == ["questions_due", "response_due", "other_deadline", "naics", "required_content", "set_aside", "participation_goal", "conference"]


def test_check_dates(spark):
    rows = [
        item(1, "response_due", "s", "due October 16, 2026 at 2:00 pm", date="2026-10-17", time="14:00"), item(2, "response_due", "s", "8/7/26 8/13/26", date="2026-08-13"), item(3, "naics", "s", "q", date="soon"), item(4, "naics", "s", "at 9:00 am", time="10:00"),
        item(5, "naics", "s", None, date=None, time=None),
    ]
    got = items.check_dates(frame(spark, rows)).orderBy("seq").collect()
    assert [len(r["warnings"]) for r in got] == [1, 1, 1, 1, 0]
    assert got[0]["date"] == "2026-10-17" and got[2]["date"] == ""


def greedy(rows):
    def same(a, b):
        if a[8] and b[8] and a[8] != b[8] or a[10] and b[10] and a[10] != b[10]:
            return False
        r = lambda x, y: SequenceMatcher(None, x.lower(), y.lower(), autojunk=False).ratio()
        q = r(a[4], b[4])
        return q > 0.8 or (q > 0.5 and r(a[3], b[3]) > 0.9)

    out, also = [], {}
    for b in sorted(rows, key=lambda i: (i[7] != "amendment", i[7] == "attachment", i[6], i[5] or 0, i[1])):
        twin = next((a for a in out if a[0] == b[0] and a[2] == b[2] and same(a, b)), None)
        if twin is None:
            out.append(b)
        elif twin[6] == b[6] and b[5] and b[5] != twin[5]:
            also.setdefault(twin[1], set()).add(b[5])
    return sorted(i[1] for i in out), {k: sorted(v) for k, v in also.items()}


def test_merge_is_greedy_in_reading_order(spark):
    base = "the vendor shall deliver sealed proposals for the harbor crane to the purchasing office"
    rows = [
        item(1, "k", "deliver proposals", base + " today", page=5), item(2, "k", "deliver proposals", base, page=2), item(3, "k", "deliver proposals", base, page=2, role="amendment", document="a1"),
        item(4, "k", "include the unique entity identifier", "include the registered entity identifier number", page=3), item(5, "k", "include the unique entity number", "attach the audited balance sheet of the firm", page=3),
        item(6, "k", "deadline", base + " by monday", page=7, date="2026-01-01"), item(7, "k", "deadline", base + " by monday", page=8, date="2026-02-01"), item(8, "other", "deliver proposals", base, page=9), item(9, "k", "deliver proposals", base, page=None), item(10, "k", "d", base, page=4, package="q"),
    ]
    kept, also = greedy(rows)
    got = items.merge(frame(spark, rows)).collect()
    assert sorted(r["seq"] for r in got) == kept
    assert {r["seq"]: r["also_on"] for r in got if r["also_on"]} == also


def test_merge_of_equal_quotes_keeps_first(spark):
    rows = [item(k, "k", "s", "exactly the same words in every one of these quotes", page=k) for k in (5, 2, 9, 2)]
    rows = [r[:1] + (n,) + r[2:] for n, r in enumerate(rows)]
    got = items.merge(frame(spark, rows)).collect()
    assert [(r["page"], r["also_on"]) for r in got] == [(2, [5, 9])]


def test_merge_takes_copies_of_an_absorbed_item(spark):
    base = "the vendor shall deliver sealed proposals for the harbor crane to the purchasing office"
    rows = [item(1, "k", "deliver proposals", base + " today", page=1)]
    rows += [item(n, "k", "deliver proposals", base, page=n) for n in range(2, 6)]
    # as equal as those, but for a statement, a date of its own or none
    rows += [item(6, "k", "bring proposals", base, page=6), item(7, "k", "deliver proposals", base, page=7, date="2026-01-01"), item(8, "k", "deliver proposals", base, page=8, date="2026-02-01"), item(9, "k", "deliver proposals", base, page=9, date="2026-02-01")]
    kept, also = greedy(rows)
    got = items.merge(frame(spark, rows)).collect()
    assert sorted(r["seq"] for r in got) == kept == [1]
    assert {r["seq"]: r["also_on"] for r in got if r["also_on"]} == also


def test_merge_of_items_with_rarer_words_of_their_own(spark, monkeypatch):
    shared = "responsibility documentation certification requirements administration representative correspondence organization communication specification".split()
    own = {x: [f"{x}{n}" for n in range(8)] for x in "xz"}
    # every own word occurs twice, every shared word oftener
    rows = [item(n, "k", "s", " ".join(shared + own[x]), page=n) for n, x in ((1, "x"), (2, "z"))]
    rows += [item(n, "k", f"t{n}", " ".join(own[x]), page=n) for n, x in ((3, "x"), (4, "z"))]
    rows += [item(n, "k", f"u{n}", " ".join((shared[n - 5:] + shared[:n - 5])[::-1]), page=n) for n in range(5, 9)]
    kept, also = greedy(rows)
    assert 2 in also[1]
    for block in (items.BLOCK, 3):  # in one block, and cut into several
        monkeypatch.setattr(items, "BLOCK", block)
        got = items.merge(frame(spark, rows)).collect()
        assert sorted(r["seq"] for r in got) == kept
        assert {r["seq"]: r["also_on"] for r in got if r["also_on"]} == also


def test_likeness_bounds_are_never_too_low():
    texts = ["", "a", "a b", "the vendor delivers", "vendor the delivers", "x" * 64, "x" * 65 + " y", "y " + "x" * 130, "ab1 " * 50, "1ba " * 49]
    t = items._Texts(texts)
    x, y = (np.repeat(np.arange(len(texts)), len(texts)), np.tile(np.arange(len(texts)), len(texts)))
    ordered = t.in_order(x, y)
    for i, j, n in zip(x, y, ordered):
        matched = sum(m.size for m in SequenceMatcher(None, texts[i], texts[j], autojunk=False).get_matching_blocks())
        assert matched <= n <= t.common(i, np.array([j]))[0]
    assert [ordered[i * len(texts) + j] for i, j in ((0, 1), (3, 4), (5, 6), (6, 7), (8, 8))] == [0, 15, 64, 65, 200]


def test_texts_side_by_side_and_by_class():
    import random

    r = random.Random(3)
    texts = ["", "a", "the vendor delivers", "x" * 63, "x" * 64 + " y", "y " + "x" * 130, *("".join(r.choices("etaoin shrdlu019", k=r.randint(0, 400))) for _ in range(40))]
    t, every = items._Texts(texts), np.arange(46)
    for x in range(len(texts)):
        ordered = t.in_order(np.full(46, x), every)
        assert (t.against(x, every) == ordered).all()
        parts = np.stack([p.against(x, every) for p in t.parts], axis=1)
        assert (parts.sum(axis=1) >= ordered).all() and (parts <= t.shared(x, every)).all()


def test_large_groups_merge_as_all_pairs_do(spark):
    import random

    r, words_ = random.Random(5), "vendor shall deliver sealed proposals harbor crane office before monday twelve copies signed original bond".split()
    rows = []
    for n in range(120):
        text = r.sample(words_, 12) if n % 3 or not rows else [w for w in rows[r.randrange(len(rows))][4].split() if r.random() > 0.08]
        rows.append(item(n, "k", r.choice(["deliver proposals in time", "sign the bond"]), " ".join(text), page=n % 9 + 1, date=r.choice(["", "", "2026-01-01", "2026-02-01"])))
    kept, also = greedy(rows)
    got = items.merge(frame(spark, rows)).collect()
    assert sorted(x["seq"] for x in got) == kept and len(kept) < 110
    assert {x["seq"]: x["also_on"] for x in got if x["also_on"]} == also


def test_amendments_and_facts(spark):
    rows = [
        item(1, "response_due", "due", "q", date="2026-08-07"), item(2, "response_due", "due", "q", date="2026-08-13", role="amendment", document="add2"), item(3, "response_due", "due", "q", date="2026-08-13", document="b"),
        item(4, "questions_due", "ask", "q", date="2026-07-02"), item(5, "questions_due", "ask", "q", date="2026-07-03"), item(6, "questions_due", "ask", "q", date="2026-07-03"), item(7, "page_limit", "first", "q"), item(8, "page_limit", "second", "q"),
        item(9, "submission_method", "debrief requests go by email", "email"), item(10, "submission_method", "send bids by email", "the portal takes bids"), item(11, "basis_of_award", "points", "weights"), item(12, "basis_of_award", "award to best value", "award"),
    ]
    done = items.apply_amendments(frame(spark, rows))
    assert {r["seq"]: r["superseded_by"] for r in done.collect() if r["superseded_by"]} == {1: "add2"}
    got = {r["fact"]: r["seq"] for r in facts.key_facts(done).collect()}
    assert got == {"response_due": 2, "questions_due": 5, "page_limit": 7, "submission_method": 10, "basis_of_award": 12}
    s = facts.stats(done).collect()[0]
    assert (s["kept"], s["superseded"], s["exact"]) == (11, 1, 12)


def test_keyword_baseline(spark):
    text = "Questions on proposals are due March 3, 2026 at noon. More questions on the proposal are due March 4, 2026. Proposals shall be submitted through the portal. Responses must not exceed a limit of 20 pages. Technical factor is worth (40 points) of the score."
    p = spark.createDataFrame([("p", "base", "base", 1, text), ("p", "amd", "amendment", 1, "Nothing of note is to be found in this text.")], "package_id string, doc_id string, role string, page int, text string")
    got = {}
    for r in keyword.baseline(p).collect():
        got.setdefault(r["kind"], []).append((r["date"], r["time"], r["weight"], r["statement"][:9]))
    assert got["questions_due"] == [("2026-03-03", "12:00", "", "Questions")]
    assert got["response_due"] == [("2026-03-04", "", "", "More ques")]
    assert [x[3] for x in got["submission_method"]] == ["Proposals"] and len(got["page_limit"]) == 1
    assert [x[2] for x in got["evaluation_factor"]] == ["(40 points)"]
    assert len(got["required_content"]) == 4


def test_scoring(spark):
    gold = spark.createDataFrame([("p", "a", False, None, None, None), ("p", "b", True, "2026-01-01", "12:00", None), ("p", "c", True, "", "", ["email", "portal"]), ("p", "d", True, "", "", ["x"])], "package_id string, fact string, stated boolean, date string, time string, any array<string>")
    found = spark.createDataFrame([("p", "b", "s", "q", "2026-01-01", "13:00"), ("p", "c", "The Portal", "q", "", "")], "package_id string, fact string, statement string, quote string, date string, time string")
    got = {r["fact"]: (r["correct"], r["time_correct"]) for r in scoring.score_facts(gold, found).collect()}
    assert got == {"a": (True, None), "b": (True, False), "c": (True, None), "d": (False, None)}
    t = [r for r in scoring.totals(scoring.score_facts(gold, found)).collect() if r["package_id"] is None][0]
    assert (t["facts_correct"], t["facts_total"], t["times_correct"], t["times_total"]) == (3, 4, 0, 1)
    lines = spark.createDataFrame([("p", 1, [["alpha"], ["beta", "gamma"]]), ("p", 2, [["alpha"], ["omega"]])], "package_id string, id int, all array<array<string>>")
    i = frame(spark, [item(1, "k", "Alpha", "and Gamma"), item(2, "k", "Omega", "alone")])
    assert {r["id"]: r["found"] for r in scoring.score_checklist(lines, i).collect()} == {1: True, 2: False}


def test_redaction(spark):
    rows = [("p", "Write to pat.quill@example.gov or 212-555-0100 x3"), ("p", "PAT QUILL signs. Attn: Sam Roe Jr about it"), ("p", "Primary Contact: Lee Ann Doe at [email]"), ("p", "Nothing here"), ("q", "Pat Quill elsewhere"), ("p", None), ("p", "Send it to Pat Quill's office, the Pat Quill-led team or 'Pat Quill'."), ("p", "contactDana Wu Roe at once"), ("p", "Sam.Roe's and Sam  ROE/others")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, package_id string, t string")
    got = [r["t"] for r in redaction.redact(df, "t").orderBy("i").collect()]
    assert got[0] == "Write to [email] or [phone]" and got[3] == "Nothing here" and got[4] == "Pat Quill elsewhere" and got[5] is None
    assert got[1].startswith("[name] signs. Attn: [name]") and got[2] == "Primary Contact: [name] at [email]"
    assert got[6] == "Send it to [name]'s office, the [name]-led team or '[name]'." and got[7] == "contact [name] at once"


def test_reports(spark):
    base = frame(spark, [item(1, "naics", "<b>S", "q", page=3, superseded="x", weight="5"), item(2, "odd", "T", "r", page=None, document="e")]).withColumn("base", F.lit("d")).withColumn("short", F.lit("Two"))
    base = base.withColumn("end_page", F.when(F.col("seq") == 1, 4)).withColumn("also_on", F.when(F.col("seq") == 1, F.array(F.lit(7), F.lit(9))).otherwise(F.array().cast("array<int>"))).withColumn("warnings", F.array(F.lit("w")))
    lines = [r["line"] for r in reports.item_lines(base).orderBy("seq", "nth").collect()]
    assert lines == ["- [ ] ~~<b>S~~ **5** (pp. 3–4, also p. 7, 9)", "  > q", "  - Check: w", "- [ ] T (Two, p. None)", "  > r", "  - Check: w"]
    assert "&lt;b&gt;S" in reports.html(base).orderBy("seq").first()["line"]


class Echo:
    name, model = "local", "echo"

    def __init__(self, log):
        self.log = log

    def complete(self, system, user, schema, budget):
        with open(self.log, "a") as f:
            f.write(f"{budget}\n")
        if "dense" in user and (budget < 2000 or "hopeless" in user and "PAGE 4" in user):
            raise replies.TooLong("budget")
        if "fail" in user:
            raise ValueError("no")
        return user.rsplit("\n", 1)[-1].upper()


def test_replies_and_cache(spark, tmp_path):
    log, store = str(tmp_path / "log"), str(tmp_path / "cache")
    page = lambda n, t: f"<<<PAGE {n}>>>\n{t}"
    chunks = spark.createDataFrame([
        ("d", 0, [1], page(1, "one")), ("d", 1, [2, 3], page(2, "dense a") + "\n\n" + page(3, "dense b")), ("d", 2, [6], page(6, "fail")), ("d", 3, [1], page(1, "one")),
        ("d", 4, [4, 5], page(4, "dense hopeless") + "\n\n" + page(5, "dense c")), ("d", 5, [], ""), ("d", 6, None, None)], "doc_id string, chunk_idx int, pages array<int>, text string")
    answers, entries = replies.ask(chunks, Echo(log), budget=1000)
    got = {(r["chunk_idx"], r["page"]): (r["reply"], r["error"], r["hit"]) for r in answers.collect()}
    assert got == {
        (0, None): ("ONE", None, False), (3, None): ("ONE", None, True), (1, None): (None, "too_long", False), (1, 2): ("DENSE A", None, False), (1, 3): ("DENSE B", None, False),
        (2, None): (None, "pages 6-6: no", False), (4, None): (None, "too_long", False), (4, 4): (None, "page 4: too_long", False), (4, 5): ("DENSE C", None, False)}
    assert sorted(open(log).read().split()) == ["1000"] * 4 + ["2000"] * 4
    assert sorted(r["error"] for r in replies.errors(answers).collect()) == ["page 4: too_long", "pages 6-6: no"]
    replies.keep(entries, store)
    again, more = replies.ask(chunks, Echo(log), replies.kept(spark, store), budget=1000)
    c = replies.counters(again).first()
    assert (c["requests"], c["hits"], c["misses"], c["too_long"], c["failed"]) == (9, 8, 1, 2, 2) and more.count() == 0
    assert len(open(log).read().split()) == 9  # what failed is asked again
    other = Echo(log)
    other.model = "another"
    assert replies.counters(replies.ask(chunks, other, replies.kept(spark, store), budget=1000)[0]).first()["misses"] == 8


def test_files(spark, tmp_path):
    (tmp_path / "base-doc.txt").write_bytes(b"one\ftwo\f")
    got = files.page_texts(spark, str(tmp_path / "*.txt")).orderBy("page").collect()
    assert [(r["doc_id"], r["page"], r["text"]) for r in got] == [("base-doc", 1, "one"), ("base-doc", 2, "two")]
    assert files.checksums(spark, str(tmp_path / "*.txt")).first()["is_pdf"] is False
    pdf = "JVBERi0xLjQ="
    up = spark.createDataFrame([("a", [("x y.pdf", "base", pdf)]), ("b", [("x", "other", pdf)]), ("c", []), ("d", [("x", "base", "aGk=")]), ("e", None)], "id string, files array<struct<name string, role string, data string>>")
    errors = {r["id"]: r["error"] for r in files.uploads(up).collect()}
    assert errors == {"a": None, "b": "exactly one base document is needed", "c": "no files", "d": "not a PDF", "e": "no files"}
    names = spark.createDataFrame([(0, "z.pdf"), (1, "Amendment_2.pdf"), (2, "map.pdf")], "at int, name string")
    assert [r["r"] for r in names.select(files.guessed_role(F.col("at"), F.col("name")).alias("r")).collect()] == ["base", "amendment", "attachment"]


def test_analysis_and_report(spark):
    from bidweave.plans import pipeline

    p = spark.createDataFrame(PAGES, "doc_id string, page int, text string, reading string")
    rows = [
        item(1, "required_content", "Deliver it", "deliver the approach/solution within thirty days", page=1), item(2, "required_content", "Deliver it", "deliver the approach/solution within thirty days", page=2),
        item(3, "naics", "Invented", "an invented sentence about submarines and volcanoes in space", page=1),
    ]
    done = pipeline.analyze(frame(spark, rows), p)
    assert [(r["seq"], r["page"], len(r["warnings"])) for r in done.items.collect()] == [(1, 2, 1)]
    assert [r["seq"] for r in done.rejected.collect()] == [3]
    s = done.stats.first()
    assert (s["kept"], s["rejected"], s["warnings"]) == (1, 1, 1)
    packages = spark.createDataFrame([("p", "Title", "d")], "package_id string, title string, base string")
    manifest = spark.createDataFrame([("d", "Doc", None)], "id string, title string, short string")
    lines = [r["line"] for r in pipeline.report(done, packages, manifest).orderBy("part", "section", "seq", "nth").collect()]
    assert lines[0] == "# Title" and "- **NAICS:** Not found" in lines and "- [ ] Deliver it (p. 2)" in lines and lines[-1] == "- Invented (claimed p. 1)"


def test_command(spark, tmp_path, monkeypatch):
    from bidweave import __main__ as command

    (tmp_path / "base.txt").write_text("Offers shall be delivered to pat.quill@example.gov by the portal.\f")
    monkeypatch.setattr(command, "local_session", lambda: spark)
    command.main(["baseline", str(tmp_path / "base.txt"), "--out", str(tmp_path / "out"), "--redact-contacts"])
    got = spark.read.json(str(tmp_path / "out")).collect()
    assert {r["kind"] for r in got} == {"required_content", "submission_method"} and all("[email]" in r["quote"] for r in got)


class Reader:
    """Items for two of the words a test page has."""

    name, model = "local", "reader"

    def complete(self, system, user, schema, budget):
        item = {"kind": "submission_method", "statement": "Send <offers> to Pat Quill", "quote": "Offers shall be delivered to pat.quill@example.gov by the portal", "page": 1}
        lost = {"kind": "naics", "statement": "Made up", "quote": "Volcanoes shall be visited by all submarines", "page": 1}
        factor = {"kind": "evaluation_factor", "statement": "Experience", "quote": "Experience counts for 40 points of the evaluation", "page": 2, "weight": "40 points"}
        import json

        return json.dumps({"items": [item, lost, factor]}) if "Offers" in user else "nothing"


def test_analyze_command(spark, tmp_path, monkeypatch):
    import json
    import sys
    import types

    from bidweave import __main__ as command

    (tmp_path / "base.txt").write_text("Offers shall be delivered to pat.quill@example.gov by the portal.\fExperience counts for 40 points of the evaluation.\f")
    monkeypatch.setattr(command, "local_session", lambda: spark)
    module = types.ModuleType("own_provider")
    module.it = Reader()
    monkeypatch.setitem(sys.modules, "own_provider", module)
    out = str(tmp_path / "out")
    command.main(["analyze", str(tmp_path / "base.txt"), "--provider", "own_provider:it", "--title", "T & U", "--out", out, "--cache", str(tmp_path / "cache"), "--redact-contacts"])
    read = lambda kind: "\n".join(x for f in sorted((tmp_path / "out" / kind).rglob("part-*")) for x in f.read_text().splitlines())
    report = json.loads(read("json"))
    assert report["title"] == "T & U" and [x["kind"] for x in report["items"]] == ["submission_method", "evaluation_factor"] and [x["statement"] for x in report["rejected"]] == ["Made up"]
    assert report["key_facts"]["submission_method"]["quote"] == "Offers shall be delivered to [email] by the portal" and report["items"][0]["statement"] == "Send <offers> to [name]"
    assert report["stats"]["kept"] == 2 and report["stats"]["rejected"] == 1 and [x["weight"] for x in report["evaluation_factors"]] == ["40 points"] and report["documents"][0]["pages"] == 2
    text = read("markdown")
    assert "- **Page limit:** Not found" in text and "with reader. Every item" in text and text.splitlines()[-1] == "- Made up (claimed p. 1)"
    page = read("html")
    assert page.startswith("<!doctype html>") and "Send &lt;offers&gt; to [name]" in page and "<td>40 points</td>" in page and page.endswith("</body></html>")
    assert replies.kept(spark, str(tmp_path / "cache")).count() == 1


def test_landing_stream_counts_each_record_once(spark, small):
    from bidweave.plans import catalog

    counted = catalog.landed_items(spark, small).selectExpr("sum(items) AS n").first()["n"]
    assert counted == spark.read.parquet(f"{small}/items.parquet").where("extracted_at IS NOT NULL").select("seq").distinct().count()


def test_scores_find_parts_of_words_and_every_line(spark, tmp_path):
    found = [item(1, "evaluation_factor", "Pricing Plan", "the re-bid bonds, insured", weight="40 points"), item(2, "k", "late", None, package="q")]
    lines = [("p", 1, [["pric"], ["bid bond"]]), ("p", 2, [["pric"], ["late"]]), ("p", 3, [["-"]]), ("p", 4, [["Pric"]]), ("p", 5, []), ("p", 6, [["zzz", "s"], ["in", None]]), ("r", 7, []), ("p", 8, [[]]), ("q", 9, [["late"]]), ("p", 10, [["pric"], ["bid bond"]])]
    gold = spark.createDataFrame(lines, "package_id string, id long, all array<array<string>>")
    got = {r["id"]: r["found"] for r in scoring.score_checklist(gold, frame(spark, found)).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True, 7: False, 8: False, 9: True, 10: True}
    gold = spark.createDataFrame([("p", 1, ["ricing"], "40"), ("p", 2, ["ricing"], "50"), ("p", 3, ["plan"], None), ("p", 4, [None], None)], "package_id string, id long, names array<string>, weight string")
    assert {r["id"]: r["found"] for r in scoring.score_factors(gold, frame(spark, found)).collect()} == {1: True, 2: False, 3: True, 4: False}
    # a package's lines past the twelfth are scored too
    from bidweave.plans import catalog
    both = [item(n, "evaluation_factor", f"first second third{n}", "q") + ("a",) for n in range(1, 31)] + [item(n, "evaluation_factor", f"first second third{n}", "q") + ("b",) for n in range(41, 50)]
    rows = spark.createDataFrame(both, ITEM + ", model string").withColumn("loaded_at", F.lit("2026-01-01"))
    rows.write.parquet(str(tmp_path / "items.parquet"))
    assert catalog.QUERIES["score_checklist"](spark, str(tmp_path)).count() == catalog.QUERIES["score_factors"](spark, str(tmp_path)).count() == 30


def test_reference_answers(spark, tmp_path):
    import json

    (tmp_path / "p.json").write_text(json.dumps({
        "facts": {"naics": {"any": ["541"]}, "set_aside": None, "response_due": {"date": "2026-01-02", "time": "12:00", "page": 3}},
        "evaluation_factors": [{"name": ["price", "cost"], "weight": None}], "checklist": [{"id": "c1", "text": "Sign it", "all": [["sign"], ["form"]]}]}))
    gold = files.gold(spark, str(tmp_path / "*.json"))
    found = frame(spark, [item(1, "naics", "Code 541", "q"), item(2, "response_due", "Due", "q", date="2026-01-02", time="13:00"), item(3, "evaluation_factor", "The Cost", "counts")])
    facts_ = scoring.score_facts(scoring.gold_facts(gold), found.where("kind <> 'evaluation_factor'").withColumn("fact", F.col("kind")))
    assert {r["fact"]: r["verdict"] for r in scoring.verdict(facts_).collect()} == {"naics": "yes", "set_aside": "yes", "response_due": "date only"}
    lines = scoring.gold_checklist(gold)
    covered = scoring.score_checklist(lines, found)
    r = scoring.results(facts_, scoring.score_factors(scoring.gold_factors(gold), found.where("kind = 'evaluation_factor'")), covered, found)
    total = r.where("package_id IS NULL").first()
    assert [total[c] for c in ("facts_correct", "facts_total", "times_correct", "times_total", "factors_found", "checklist_found", "items")] == [3, 3, 0, 1, 1, 0, 3]
    assert [x["text"] for x in scoring.missed(covered, lines).collect()] == ["Sign it"]
    table = [x["line"] for x in scoring.table(r, r).where("package_id IS NULL").orderBy("nth").collect()]
    assert table[2] == "| Key facts right | 3/3 (100%) | 3/3 (100%) |" and table[-1] == "| Items returned | 3 | 3 |"


def test_ledger(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    files.keep_checksums(files.checksums(spark, str(tmp_path / "in" / "*.txt")), str(tmp_path / "ledger"))
    (tmp_path / "in" / "a.txt").write_text("two")
    assert files.checksums(spark, str(tmp_path / "in" / "*.txt"), files.kept_checksums(spark, str(tmp_path / "ledger"))).first()["changed"] is True
