"""Text columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from bidweave.functions import constants as K


def strip(c: Column) -> Column:
    """Without white space, as Unicode sees it, at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def empty(c: Column) -> Column:
    """NULL as the empty string."""
    return F.coalesce(c, F.lit(""))


def has(c: Column, pattern: str) -> Column:
    """Whether a pattern occurs, upper and lower case alike; never NULL."""
    return F.coalesce(c.rlike("(?iU)" + pattern), F.lit(False))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """NFKC; Spark has no built-in. Use ``with_nfkc`` where most rows are ASCII."""
    return _nfkc(c)


def words(c: Column) -> Column:
    """Runs of ``a-z0-9`` after lowercasing; NFKC is the caller's (most text needs none)."""
    return F.array_remove(F.split(F.lower(empty(c)), "[^a-z0-9]+"), "")


def squash(c: Column) -> Column:
    """Letters and digits only, so that line breaks and hyphens don't count."""
    return F.regexp_replace(F.lower(empty(c)), "[^a-z0-9]+", "")


def with_nfkc(df, column: str):
    """``df`` with ``column`` in NFKC. Rows of plain ASCII stay in the JVM; the others go through Arrow."""
    plain = ~F.coalesce(F.col(column).rlike(r"[^\x00-\x7f]"), F.lit(False))
    return df.where(plain).unionByName(df.where(~plain).withColumn(column, nfkc(F.col(column))))


def sentences(c: Column) -> Column:
    """Sentences: blocks at blank lines, white space collapsed, cut behind ``.`` or ``;`` before a capital or ``(``; more
    than 15 characters."""
    blocks = F.transform(F.split(empty(c), r"\n\s*\n"), lambda b: strip(F.regexp_replace(b, r"(?U)\s+", " ")))
    cut = F.flatten(F.transform(blocks, lambda b: F.split(b, r"(?<=[.;])\s+(?=[A-Z(])")))
    return F.filter(cut, lambda s: F.length(s) > 15)


def strip_footer(c: Column) -> Column:
    """Without the lines at the end that are blank or page numbers: the lines up to the last one that is neither."""
    lines = F.split(F.regexp_replace(empty(c), r"(?U)\s+$", ""), "\n")
    furniture = rf"(?i)^(?:[^\S\n]*|{K.FOOTER})$"
    last = F.array_max(F.transform(lines, lambda x, i: F.when(x.rlike(furniture), 0).otherwise(i + 1)))
    return F.array_join(F.slice(lines, 1, F.coalesce(last, F.lit(0))), "\n")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def file_name(c: Column) -> Column:
    """A safe file name of at most 60 characters."""
    safe = F.regexp_replace(F.regexp_replace(empty(c), "[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.coalesce(F.nullif(F.substring(safe, 1, 60), F.lit("")), F.lit("document"))


def json_body(c: Column) -> Column:
    """What stands between the first ``{`` and the last ``}``, code fences and prose around it gone."""
    body = F.regexp_replace(strip(empty(c)), r"^```(?:json)?\s*|\s*```$", "")
    begin, end = F.instr(body, "{"), F.length(body) - F.instr(F.reverse(body), "}") + 1
    return F.when((begin > 0) & (F.instr(body, "}") > 0) & (end > begin), F.substring(body, begin, end - begin + 1))


def percent(a: Column, b: Column) -> Column:
    """``a/b (p%)``, the percentage rounded half to even, ``0%`` for nothing of nothing."""
    return F.when(b == 0, F.lit("0%")).otherwise(F.format_string("%d/%d (%d%%)", a, b, F.bround(100.0 * a / b).cast("int")))
