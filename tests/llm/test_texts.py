"""Truncation, plain form, residue."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bidweave.llm import plain, residue, truncated


def test_limit_mark_habit_and_ending(spark):
    r = random.Random(3)
    nouns, places = ["crane", "pump", "ledger", "server", "bridge", "kiosk"], [f"Place{chr(97 + k)}" for k in range(20)]
    sentence = lambda: f"The vendor delivers the {r.choice(nouns)} and the {r.choice(nouns)} to {r.choice(places)} before the {r.choice(nouns)} phase at {r.choice(places)} begins"
    rows, cut = [], set()
    for k in range(600):
        text = sentence() + "; " + sentence() + "." + (" It is so." if k % 3 else "")
        rows.append((k, "free", text, None))
    for k in range(1000, 1200):
        text = sentence() + " " + sentence() + "."
        if k % 2 and len(text) > 120:
            text = text[:120]
            if k % 4 == 1:
                text = text[:-1] + ")"  # cut behind a bracket
            if not text.endswith("."):
                cut.add(k)
        rows.append((k, "limited", text, ""))
    rows += [(2000, "free", "The vendor delivers the crane and the…", ""), (2001, "free", "The vendor delivers the cra�", " "), (2002, "free", "The vendor delivers the crane and the", None), (2003, None, "Ends well.", "x"), (2004, "free", "The vendor delivers the crane to the pla&am", "R&D."), (None, "free", "The vendor deliv", None)]
    cut |= {2000, 2001, 2002, 2004}
    df = spark.createDataFrame([(*x, "clash") for x in rows + rows[-5:]], "seq long, model string, quote string, statement string, source string")
    got, values = truncated.truncated(df, "seq", "model", ["quote", "statement"])
    found = {(x["key"], x["field"]): x["reason"] for x in got.collect()}
    quotes = {k for k, f in found if f == "quote"}
    assert cut <= quotes and len(quotes - cut) <= 1
    assert {found[k, "quote"] for k in cut if 1000 <= k < 1200} == {"limit"} and found[2000, "quote"] == found[2001, "quote"] == "mark"
    rates = {x["source"]: x for x in truncated.rates(got, values).collect()}
    assert rates["limited"]["cut"] == len([k for k in cut if 1000 <= k < 1200]) and rates["limited"]["items"] == 200
    none, there = truncated.truncated(df.limit(0), "seq", "model", ["quote"])
    assert none.collect() == [] and there.collect() == []


PLAIN = {
    "ｆｕｌｌ　ｗｉｄｔｈ": "full width", "café": "café", "oﬃce": "office", "zero​width﻿": "zerowidth", "no break thin": "no break thin", "soft­hyphen": "softhyphen",
    "рroсess": "process", "а plan": "a plan", "Εvery οffer": "Every offer", "ӧffnen": "öffnen",
}
SAME = ["plain ASCII, only.", "résumé façade Über", "per ГОСТ 7731 «Изделия»", "завод Дружба-7", "Ψηφιακή Πύλη", "Δθ below 3", "5 μm", "§ 3 – “quoted”… ™ �", "", "tab\tand\nline\x0cfeed", "سلام‌ها", "²³"]


@pytest.mark.parametrize("text,form", PLAIN.items())
def test_plain_form(text, form):
    assert plain.plain(text) == form


@pytest.mark.parametrize("text", SAME)
def test_what_has_a_look_of_its_own_stays(text):
    assert plain.plain(text) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aé̈ｂ​ ﬁора ουΔГ.\ņc"), max_size=30))
def test_plain_is_a_fixed_point(text):
    once = plain.plain(text)
    assert plain.plain(once) == once


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text_has_a_fixed_plain_form(text):
    once = plain.plain(text)
    assert plain.plain(once) == once


def test_units_and_context():
    units = plain.Transducer()
    assert units["e\u200b\u0301"] == ("é", "é", plain.LATIN) and units["\u0430\u0308"] == ("ӓ", "ä", plain.ALIKE) and units["Г"] == ("Г", "Г", plain.OTHER)
    assert units.run("а и Г") == "а и Г" and units.run("а, b а") == "a, b a" and units.run("Г b а") == "Г b a" and units.run("а\u200b") == "a"


def test_mapping_has_no_conflicts():
    table = plain.mapping()
    assert table["　"] == " " and table["ﬁ"] == "fi" and table["​"] == "" and "é" not in table
    assert all(unicodedata.normalize("NFC", t) == t for t in table.values())


def test_plain_frame(spark):
    df = spark.createDataFrame([("a", 1, None, 5), ("a", 2, "", 5), ("a", None, "ｘ", 5), ("b", 1, "ok", 5)], "kind string, id long, text string, plain int")
    got = {(r["kind"], r["id"]): r["plain"] for r in plain.to_plain(df).collect()}
    assert got == {("a", 1): None, ("a", 2): "", ("a", None): "x", ("b", 1): "ok"}


RESIDUE = {
    "Dear {{ vendor_name }}, welcome": "placeholder", "Send it to [INSERT DUE DATE] now": "placeholder", "The <CITY> office": "placeholder", "Due XX/XX/20XX at noon": "placeholder", "por «site_name» el lunes": "placeholder",
    "Lorem ipsum dolor sit amet": "filler", "Test entry 12, please ignore.": "filler", "Put the scope description in this space.": "filler",
    "To do: staffing.": "filler", "Dummy background content for layout purposes.": "filler", "Heading One.": "filler", "Example scope only - overwrite.": "filler", "Accès refusé au document demandé.": "error", "That document is gone (code a1b2).": "error",
    "We are verifying that you are human.": "notice", "You need to enable JavaScript to run this app.": "notice", "To view the tender, please turn off the ad blocker and refresh.": "notice", "Debe aceptar las cookies para continuar.": "notice", "Ihr Browser wird nicht unterstützt.": "notice",
    "404: The page could not be located.": "error", "Your session timed out.": "error", "la página solicitada no existe.": "error", "Die Seite wurde nicht gefunden.": "error", "This portal is down for scheduled upkeep.": "error",
}
CLEAN = [
    "Merge fields such as {{pump_no}} in the letters must be listed in the signature page.", "The line [Amendment 0009] was struck and [sic] marks the rollout.", "The bidder shall insert its price in column <F> of the workbook.",
    "Before launch the vendor replaces all lorem ipsum in the mockups.", "Pages of the viewer shall stay readable when JavaScript is switched off.", "Cookies used by the site are described in the filter policy.", "Error rates above 7 in 504 samples trigger a review.",
    "Vendors will test how the site reports a 503 while it restarts.", "The portal must answer unknown links with a plain 404 page.", "Signature: ____________ (completed by the bidder)", "Carry $2,500,000 of cover.", "",
]


@pytest.mark.parametrize("text,reason", RESIDUE.items())
def test_residue(text, reason):
    assert reason in residue.reasons_of(text)


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert not residue.reasons_of(text) - {"suspect"}


def test_residue_frame(spark):
    rows = [(k, f"Real content about crane number {k} of Loudra{chr(97 + k)}.\nThis page is resting, reload it.", f"host{k % 2}", f"Loudra{chr(97 + k)}") for k in range(4)]
    rows += [(10, None, None, None), (11, "", "h", ""), (12, "The crane shall be red.", None, None), (None, "Lorem ipsum dolor sit amet", "h", "t"), (13, "x " * 20000 + "\nYour session has expired.", "h", "t"), (14, "This page is unlike any other.", "h", "t"), (15, "Staffing words words, words words.", "h", "t")]
    # nothing but responses under several titles, whatever they say
    rows += [(20 + k, f"Tumeqa {k}\nNerrol vapt emi {k}00.", f"host{k % 2}", f"Tumeqa {k}") for k in range(3)]
    # copies of one document are one title
    rows += [(30 + k, "Kosmel\nGreen paint.", f"host{k}", "Kosmel") for k in range(5)]
    # a line that comes with residue is found without it too, and what then always stands beside it
    rows += [(40 + k, f"Ziqor{chr(97 + k)} work goes on.\nYour session has expired.\nErgo vale.", f"host{k % 2}", f"Ziqor{chr(97 + k)}") for k in range(6)]
    rows += [(50, "Bramoa work goes on.\nErgo vale.\nNavel oru.", "host0", "Bramoa"), (51, "Bramob work goes on.\nNavel oru.\n400\n512.", "host1", "Bramob")]
    df = spark.createDataFrame([(*r, None, "clash") for r in rows], "doc_id long, text string, source string, title string, package_id string, reason string")
    got = {r["doc_id"]: r["reasons"] for r in residue.residue(df).collect()}
    assert got == {13: ["error"], 15: ["filler"], **{20 + k: ["company", "response"] for k in range(3)}, **{40 + k: ["company", "error"] for k in range(6)}, 50: ["company"]}
    assert residue.without_residue(df, residue.residue(df)).count() == len(rows) - len(got)
    assert residue.residue(df.limit(0)).collect() == []


SEEN_BY_SIEVE = [
    "422: Unprocessable", "Status: 507", "409 - Conflict", "Write three lines below this", "Heading:", "Content, content, content.", "Please verify that you are a human.", "error 599", "FEHLER 418", "Erreur  451",
]


@pytest.mark.parametrize("text", SEEN_BY_SIEVE)
def test_the_sieve_lets_all_forms_through(text):
    assert residue.reasons_of(text)


def test_the_sieve_loses_nothing(small):
    """Every sentence of a table, and every literal put into one, against all patterns one by one."""
    import glob

    import pyarrow.parquet as pq

    s, _, _ = residue._detectors()
    assert not s.always
    lines = {x for t in pq.read_table(glob.glob(f"{small}/documents.parquet")[0], columns=["text"]).column("text").to_pylist() if t for x in residue.sentences(t)}
    lines |= {f"{a} {b} {c}" for a in ("The page", "Error", "Diese Seite") for b in ("could not be found", "507", "wurde nicht gefunden", "cookies are disabled", "{{ x }}") for c in ("", "- try again later")} | set(RESIDUE) | set(CLEAN) | set(SEEN_BY_SIEVE)
    lines = sorted(lines)
    tried = s.tried([x.lower() for x in lines])
    for k, line in enumerate(lines):
        assert {j for j, p in enumerate(s.compiled) if p.search(line)} <= tried.get(k, set()), line


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_literals_are_necessary(data):
    """Texts generated from each detector's pattern hold one of its literals."""
    s, _, _ = residue._detectors()
    k = data.draw(st.integers(0, len(s.names) - 1))
    text = data.draw(st.from_regex(s.compiled[k]))
    assert k in s.tried([text.lower()]).get(0, set())
