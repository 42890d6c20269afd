"""Contact details out of texts, by patterns and by the names found in a package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.functions import constants as K
from bidweave.functions.text import empty

_LABELLED = r"\b" + K.CONTACT_LABEL + r"(\s*(?:is|:|-|,)?\s*)(" + K.NAME + ")"


def redact_addresses(c: Column) -> Column:
    """E-mail addresses and telephone numbers replaced."""
    return F.regexp_replace(F.regexp_replace(empty(c), "(?U)" + K.EMAIL, "[email]"), "(?iU)" + K.PHONE, "[phone]")


def contact_names(c: Column) -> Column:
    """Names behind contact labels, and of ``first.last`` addresses; at least two words and five characters."""
    text = empty(c)
    labelled = F.transform(F.regexp_extract_all(text, F.lit(_LABELLED), 3), lambda n: F.trim(n))
    local = F.transform(F.regexp_extract_all(text, F.lit("(?U)" + K.EMAIL), 0), lambda m: F.split(F.substring_index(m, "@", 1), "[._]"))
    parts = F.transform(local, lambda p: F.filter(p, lambda x: x.rlike(r"^\p{L}{2,}$")))
    named = F.transform(F.filter(parts, lambda p: F.size(p) >= 2), lambda p: F.array_join(F.slice(p, 1, 2), " "))
    return F.filter(F.array_union(labelled, named), lambda n: (F.length(n) > 4) & (F.size(F.split(n, r"\s+")) >= 2))


def redact_names(c: Column, names: Column) -> Column:
    """``names`` replaced wherever they stand, longest first, parts being kept apart by white space or dots."""
    order = F.array_sort(F.transform(names, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n"))))
    pattern = lambda n: F.concat(F.lit(r"(?iU)\b\Q"), F.array_join(F.split(n, r"\s+"), r"\E[\s.]+\Q"), F.lit(r"\E\b"))
    return F.aggregate(order, c, lambda t, n: F.regexp_replace(t, pattern(n["n"]), F.lit("[name]")))


def redact_labels(c: Column) -> Column:
    """Names behind contact labels (a blank is put between where nothing was) and before an address that was replaced."""
    c = F.regexp_replace(c, r"\b" + K.CONTACT_LABEL + r"(\s*(?:is|:|-|,)?\s+|\s*(?:is|:|-|,))(" + K.NAME + ")", "$1$2[name]")
    c = F.regexp_replace(c, r"\b" + K.CONTACT_LABEL + "(" + K.NAME + ")", "$1 [name]")
    return F.regexp_replace(c, r"\b" + K.NAME + r"(?=\s+(?:at|:|,)?\s*\[email\])", "[name]")


def names_of(texts: DataFrame, column: str, package: str = "package_id") -> DataFrame:
    """(package, name): the contact names that the texts of each package give."""
    return texts.select(package, F.explode(contact_names(F.col(column))).alias("name")).distinct()


def redact(texts: DataFrame, column: str, package: str = "package_id", names: DataFrame | None = None) -> DataFrame:
    """``texts`` with ``column`` redacted; the names of a package (package, name), by default those found in any of its texts,
    are removed from all of them.

    A text is given those of its package's names whose last word it holds, so no text is searched for every name. Texts and
    names are cut at everything but letters for this join, which only proposes: the name's pattern decides.
    """
    cut = lambda c: F.filter(F.split(F.lower(empty(c)), r"[^\p{L}]+"), lambda w: w != "")
    own = texts.withColumn("__id", F.xxhash64(package, column))
    names = (names_of(texts, column, package) if names is None else names.distinct()).withColumn("w", F.try_element_at(cut(F.col("name")), F.lit(-1)))
    held = own.select(package, "__id", F.explode(F.array_distinct(cut(F.col(column)))).alias("w")).distinct().join(names, [package, "w"])
    per = held.groupBy("__id").agg(F.collect_set("name").alias("__names"))
    both = own.join(per, "__id", "left")
    done = redact_names(redact_addresses(F.col(column)), F.coalesce("__names", F.array().cast("array<string>")))
    return both.withColumn(column, F.when(F.col(column).isNotNull(), redact_labels(done))).drop("__id", "__names")
