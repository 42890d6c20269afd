import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from bidweave.functions import dates as D
from bidweave.functions import text as T


def values(spark, rows, column, name="s"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} string")
    return [r["o"] for r in df.select("i", column.alias("o")).orderBy("i").collect()]


def test_strip_is_unicode(spark):
    assert values(spark, ["　 a b \n", "", None, "\x1c x"], T.strip(F.col("s"))) == ["a b", "", None, "x"]


def test_words_and_squash(spark):
    rows = ["Approach/solu-\ntion, 2nd", "é caf", None, "   "]
    assert values(spark, rows, T.words(F.col("s"))) == [["approach", "solu", "tion", "2nd"], ["caf"], [], []]
    assert values(spark, rows, T.squash(F.col("s"))) == ["approachsolution2nd", "caf", "", ""]


def test_nfkc_only_where_needed(spark):
    df = spark.createDataFrame([(1, "ﬁle Ｘ"), (2, "plain"), (3, None)], "i int, s string")
    got = {r["i"]: r["s"] for r in T.with_nfkc(df, "s").collect()}
    assert got == {1: unicodedata.normalize("NFKC", "ﬁle Ｘ"), 2: "plain", 3: None}


def test_sentences(spark):
    text = "The offer shall be signed. It must\nbe sealed; (See the annex for more of it.)\n\nShort one.\n\nA second block of words here"
    assert values(spark, [text, "", None], T.sentences(F.col("s"))) == [
        ["The offer shall be signed.", "It must be sealed;", "(See the annex for more of it.)", "A second block of words here"], [], []]


@pytest.mark.parametrize("text,left", [
    ("one\ntwo\n5\n", "one\ntwo"), ("one\nPage 3 of 9\n\n", "one"), ("one\nSOL-12 rev B   Page 7", "one"), ("12", ""), ("keep 12 items", "keep 12 items"), ("", ""),
])
def test_footer(spark, text, left):
    assert values(spark, [text], T.strip_footer(F.col("s"))) == [left]


def test_html_file_names_and_json(spark):
    assert values(spark, ["<b>&'\"", None], T.html_escape(T.empty(F.col("s")))) == ["&lt;b&gt;&amp;&#x27;&quot;", ""]
    assert values(spark, ["a b/c.pdf", "...", None, "x" * 80], T.file_name(F.col("s"))) == ["a-b-c.pdf", "document", "document", "x" * 60]
    assert values(spark, ['```json\n{"a":1}\n```', 'so: {"a":{}} end', "none", None, "} {"], T.json_body(F.col("s"))) == ['{"a":1}', '{"a":{}}', None, None, None]


DATES = {
    "October 16, 2026": ["2026-10-16"], "10 OCT 2026 @ 13:00": ["2026-10-10"], "12/23/2025": ["2025-12-23"], "7/8/26": ["2026-07-08"], "Sept. 4, 2026": ["2026-09-04"],
    "August 7 13, 2026": ["2026-08-07", "2026-08-13"], "due 2026-02-30": [], "2026-03-04 and 3/4/2026": ["2026-03-04"], "no date": [], "": [], "on ２０２６-01-05": ["2026-01-05"],
    "May 1st, 2026 then 1 May 2026, 4/5/27": ["2026-05-01", "2027-04-05"],
}
TIMES = {
    "12:00pm": ["12:00"], "5:00 pm": ["17:00"], "13:00 EST": ["13:00"], "2:00 PM ET": ["14:00"], "1700 CD": ["17:00"], "at noon": ["12:00"], "9 a.m. or 0930 hrs": ["09:00", "09:30"],
    "13:30 pm": [], "": [], "12:15 AM": ["00:15"],
}


def test_dates_and_times(spark):
    assert values(spark, list(DATES), D.find_dates(F.col("s"))) == list(DATES.values())
    assert values(spark, list(TIMES), D.find_times(F.col("s"))) == list(TIMES.values())
    assert values(spark, [None], D.find_dates(F.col("s"))) == [[]]


def test_display(spark):
    df = spark.createDataFrame([("2026-10-16", "12:00"), ("2026-01-05", ""), ("soon", "9:00"), (None, None), ("2026-13-01", "")], "d string, t string")
    got = df.select(D.long_form(F.col("d"), F.col("t"), F.lit("Not found")).alias("l"), D.short_form(F.col("d")).alias("s")).collect()
    assert [r["l"] for r in got] == ["October 16, 2026, 12:00 PM", "January 5, 2026", "Not found", "Not found", "Not found"]
    assert [r["s"] for r in got] == ["Oct 16, 2026", "Jan 5, 2026", "Not stated", "Not stated", "Not stated"]


def test_percent(spark):
    df = spark.createDataFrame([(1, 8), (0, 0), (29, 35)], "a int, b int")
    assert [r["p"] for r in df.select(T.percent(F.col("a"), F.col("b")).alias("p")).collect()] == ["1/8 (12%)", "0%", "29/35 (83%)"]


def test_dates_agree_with_a_plain_reading(spark, small):
    """Every ISO and numeric date of the quotes is found."""
    rows = [r["quote"] for r in spark.read.parquet(f"{small}/items.parquet").select("quote").distinct().collect() if r["quote"]]
    got = dict(zip(rows, values(spark, rows, D.find_dates(F.col("s")))))
    for q, found in got.items():
        for y, m, d in re.findall(r"(?a)\b(\d{4})-(\d{2})-(\d{2})\b", q):
            assert f"{y}-{m}-{d}" in found
