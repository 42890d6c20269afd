"""Reports: citations, lines of Markdown and HTML, JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.functions import constants as K
from bidweave.functions import dates as D
from bidweave.functions.text import empty, html_escape
from bidweave.operators.items import category


def cite() -> Column:
    """``p. 3``, ``pp. 3–4``, ``, also p. 7, 9``; with the document's short title before unless it is the base document.
    Columns: page, end_page, also_on, document, base, short."""
    page = F.coalesce(F.col("page").cast("string"), F.lit("None"))
    where = F.when(F.coalesce("end_page", F.lit(0)) != 0, F.concat(F.lit("pp. "), page, F.lit("–"), F.col("end_page").cast("string"))).otherwise(F.concat(F.lit("p. "), page))
    also = F.when(F.size("also_on") > 0, F.concat(F.lit(", also p. "), F.array_join(F.transform("also_on", lambda p: p.cast("string")), ", "))).otherwise("")
    full = F.concat(where, also)
    return F.when(F.col("document").eqNullSafe(F.col("base")), full).otherwise(F.concat(F.coalesce("short", "document", F.lit("")), F.lit(", "), full))


def with_titles(items: DataFrame, packages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Items with their package's base document and their document's short title (its title where it has none)."""
    named = manifest.select(F.col("id").alias("document"), F.coalesce(F.nullif("short", F.lit("")), F.nullif("title", F.lit(""))).alias("short"))
    base = packages.select("package_id", "base")
    return items.join(base, "package_id", "left").join(named, "document", "left")


def sections(items: DataFrame) -> DataFrame:
    """(package_id, section, category, items): each package's items by category, in the order of reports."""
    order = F.create_map(*[F.lit(x) for i, c in enumerate(K.CATEGORIES) for x in (c, i)])
    own = items.withColumn("category", category(F.col("kind")))
    return own.groupBy("package_id", "category").agg(F.count("*").alias("items")).withColumn("section", F.element_at(order, F.col("category")))


def item_lines(items: DataFrame) -> DataFrame:
    """(package_id, section, seq, nth, line): Markdown lines of items that have titles; superseded ones struck through."""
    order = F.create_map(*[F.lit(x) for i, c in enumerate(K.CATEGORIES) for x in (c, i)])
    box = F.when(empty(F.col("superseded_by")) != "", "~~").otherwise("")
    weight = F.when(empty(F.col("weight")) != "", F.concat(F.lit(" **"), F.col("weight"), F.lit("**"))).otherwise("")
    head = F.concat(F.lit("- [ ] "), box, empty(F.col("statement")), box, weight, F.lit(" ("), cite(), F.lit(")"))
    lines = F.concat(F.array(head, F.concat(F.lit("  > "), empty(F.col("quote")))), F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.concat(F.lit("  - Check: "), w)))
    return items.select("package_id", F.element_at(order, category(F.col("kind"))).alias("section"), "seq", F.posexplode(lines).alias("nth", "line"))


LABELS = {"response_due": "Response due", "questions_due": "Questions due", "submission_method": "Submit", "page_limit": "Page limit", "basis_of_award": "Basis of award", "set_aside": "Set-aside", "naics": "NAICS"}


def fact_texts(facts: DataFrame, packages: DataFrame) -> DataFrame:
    """(package_id, nth, fact, label, text, cite) for every fact of every package, in the order of reports; ``text`` is "Not
    found" and ``cite`` NULL where there is none. ``facts`` have titles."""
    names = F.posexplode(F.array(*[F.struct(F.lit(k).alias("fact"), F.lit(v).alias("label")) for k, v in LABELS.items()])).alias("nth", "f")
    every = packages.select("package_id", names).select("package_id", "nth", "f.fact", "f.label")
    text = F.when(F.col("fact").isin("response_due", "questions_due"), D.long_form(F.col("date"), F.col("time"), empty(F.col("statement")))).otherwise(empty(F.col("statement")))
    own = facts.select("package_id", "fact", text.alias("text"), cite().alias("cite"))
    return every.join(own, ["package_id", "fact"], "left").select("package_id", "nth", "fact", "label", F.coalesce("text", F.lit("Not found")).alias("text"), "cite")


def headed(packages: DataFrame, manifest: DataFrame) -> DataFrame:
    """(package_id, title): the package's title, or that of its base document."""
    named = manifest.select(F.col("id").alias("base"), F.col("title").alias("__t"))
    return packages.join(named, "base", "left").select("package_id", F.coalesce(F.nullif("title", F.lit("")), "__t", "base", F.lit("")).alias("title"))


def _lines(df: DataFrame, part: int, line: Column, section: Column | int = 0, seq: Column | int = 0, nth: Column | int = 0) -> DataFrame:
    section, seq, nth = (x if isinstance(x, Column) else F.lit(x) for x in (section, seq, nth))
    return df.select("package_id", F.lit(part).alias("part"), section.cast("int").alias("section"), seq.cast("long").alias("seq"), nth.cast("int").alias("nth"), line.alias("line"))


def _block(df: DataFrame, part: int, lines: list[Column | str], section: Column | int = 0, start: int = 0) -> DataFrame:
    """Several lines for each row."""
    own = df.select("*", F.posexplode(F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])).alias("__nth", "__line"))
    return _lines(own, part, F.col("__line"), section, start, F.col("__nth"))


def markdown(items: DataFrame, facts: DataFrame, packages: DataFrame, rejected: DataFrame | None = None, created: str = "", model: str = "") -> DataFrame:
    """(package_id, part, section, seq, nth, line): all lines of each package's report, to be read in this order. ``items``,
    ``facts`` and ``rejected`` have titles, ``packages`` is (package_id, title); packages without items have a report too."""
    meta = f"Generated {created} with {model}. Every item quotes the page it cites."
    top = _block(packages, 0, [F.concat(F.lit("# "), empty(F.col("title"))), "", meta, "", "## Key facts", ""])
    f = fact_texts(facts, packages)
    found = _lines(f, 1, F.concat(F.lit("- **"), "label", F.lit(":** "), "text", F.coalesce(F.concat(F.lit(" ("), "cite", F.lit(")")), F.lit(""))), F.col("nth"))
    titles = F.create_map(*[F.lit(x) for p in K.CATEGORY_TITLES.items() for x in p])
    heads = sections(items)
    heads = _block(heads, 2, ["", F.concat(F.lit("## "), F.element_at(titles, F.col("category"))), ""], F.col("section"), -1)
    body = item_lines(items)
    body = _lines(body, 2, F.col("line"), F.col("section"), F.col("seq"), F.col("nth"))
    parts = [top, found, heads, body]
    if rejected is not None:
        parts.append(_block(rejected.select("package_id").distinct(), 3, ["", "## Removed: quote not found in the document", ""], start=-1))
        parts.append(_lines(rejected, 3, F.concat(F.lit("- "), empty(F.col("statement")), F.lit(" (claimed p. "), F.coalesce(F.col("cited_page").cast("string"), F.lit("None")), F.lit(")")), seq=F.col("seq")))
    return reduce(DataFrame.unionByName, parts)


def html_page(items: DataFrame, facts: DataFrame, packages: DataFrame, stats: DataFrame, rejected: DataFrame | None = None, model: str = "") -> DataFrame:
    """(package_id, part, section, seq, nth, line): an HTML page for each package: facts, counts, factors, items by category
    with their warnings, and what was removed."""
    e = lambda c: html_escape(empty(F.col(c).cast("string")))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    top = _block(packages, 0, ['<!doctype html><html lang="en"><head><meta charset="utf-8">', tag("title", e("title")), "</head><body>", tag("h1", e("title")), tag("p", html_escape(F.lit(model))), "<dl>"])
    f = fact_texts(facts.where("fact <> 'evaluation_factors'"), packages)
    found = _lines(f, 1, F.concat(tag("dt", e("label")), tag("dd", F.concat(e("text"), F.coalesce(F.concat(F.lit(" "), tag("cite", html_escape(F.col("cite")))), F.lit(""))))), F.col("nth"))
    counts = [c for c in stats.columns if c != "package_id"]
    count = _block(packages.join(stats, "package_id", "left"), 2, ["</dl>", F.concat(F.lit("<p>"), F.array_join(F.array(*[F.concat(F.coalesce(F.col(c), F.lit(0)).cast("string"), F.lit(" " + c)) for c in counts]), ", "), F.lit("</p>"))])
    factors = facts.where("fact = 'evaluation_factors'")
    table = _block(factors.select("package_id").distinct(), 3, ["<table><tr><th>Factor</th><th>Weight</th><th>Page</th></tr>"], start=-1).unionByName(
        _lines(factors, 3, tag("tr", F.concat(tag("td", e("statement")), tag("td", e("weight")), tag("td", html_escape(cite())))), seq=F.col("seq"))).unionByName(
        _block(factors.select("package_id").distinct(), 4, ["</table>"]))
    titles = F.create_map(*[F.lit(x) for p in K.CATEGORY_TITLES.items() for x in p])
    heads = sections(items)
    open_ = _block(heads, 5, [tag("h2", html_escape(F.element_at(titles, F.col("category")))), "<ul>"], F.col("section"), -1)
    shut = _lines(heads, 5, F.lit("</ul>"), F.col("section"), 2**62)
    own = html(items)
    body = _lines(own, 5, F.col("line"), F.col("section"), F.col("seq"))
    parts = [top, found, count, table, open_, body, shut, _block(packages, 7, ["</body></html>"])]
    if rejected is not None:
        with_any = rejected.select("package_id").distinct()
        parts += [_block(with_any, 6, ["<h2>Removed: quote not found in the document</h2>", "<ul>"], start=-1), _lines(rejected, 6, tag("li", e("statement")), seq=F.col("seq")), _lines(with_any, 6, F.lit("</ul>"), seq=2**62)]
    return reduce(DataFrame.unionByName, parts)


ITEM_FIELDS = ("kind", "statement", "quote", "page", "document", "role", "date", "time", "weight", "verification", "similarity", "cited_page", "end_page", "also_on", "superseded_by", "warnings")


def json_report(items: DataFrame, rejected: DataFrame, facts: DataFrame, packages: DataFrame, documents: DataFrame, stats: DataFrame, errors: DataFrame, run: dict) -> DataFrame:
    """(package_id, part, section, seq, nth, line): lines that, put together in this order, are one JSON object a package:
    title, what is known of the run (``run``), documents, key_facts, stats, errors, items, rejected.

    ``packages`` is (package_id, title), ``documents`` (package_id, id, title, short, role, pages), ``errors`` (package_id,
    error). Items are lines of their own, so no package is ever gathered in one row; only facts, documents and errors are.
    """
    fields = [c for c in ITEM_FIELDS if c in items.columns]
    as_json = lambda: F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    found = facts.where("fact <> 'evaluation_factors'").groupBy("package_id").agg(F.map_from_entries(F.collect_list(F.struct("fact", F.struct(*fields)))).alias("key_facts"))
    docs = documents.groupBy("package_id").agg(F.array_sort(F.collect_list(F.struct("id", "title", "short", "role", "pages"))).alias("documents"))
    lost = errors.groupBy("package_id").agg(F.array_sort(F.collect_list("error")).alias("errors"))
    counts = [c for c in stats.columns if c != "package_id"]
    numbers = stats.select("package_id", F.struct(*counts).alias("stats"))
    whole = packages
    for part in (docs, found, numbers, lost):
        whole = whole.join(part, "package_id", "left")
    known = [F.lit(v).alias(k) for k, v in run.items()]
    head = F.to_json(F.struct("title", *known, F.coalesce("documents", F.array().cast(docs.schema["documents"].dataType)).alias("documents"), "key_facts", "stats", F.coalesce("errors", F.array().cast("array<string>")).alias("errors")), {"ignoreNullFields": "false"})
    # the object is left open for the lists of items
    top = _lines(whole, 0, F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"items":[')))

    def listed(df: DataFrame, part: int) -> DataFrame:
        first = df.groupBy("package_id").agg(F.min("seq").alias("__first"))
        comma = F.when(F.col("seq") == F.col("__first"), "").otherwise(",")
        return _lines(df.join(first, "package_id"), part, F.concat(comma, as_json()), seq=F.col("seq"))

    factors = facts.where("fact = 'evaluation_factors'")
    return reduce(DataFrame.unionByName, [
        top, listed(items, 1), _lines(packages, 2, F.lit('],"evaluation_factors":[')), listed(factors, 3), _lines(packages, 4, F.lit('],"rejected":[')), listed(rejected, 5), _lines(packages, 6, F.lit("]}"))])


def html(items: DataFrame) -> DataFrame:
    """(package_id, section, seq, line): a list entry of HTML for each item that has titles."""
    order = F.create_map(*[F.lit(x) for i, c in enumerate(K.CATEGORIES) for x in (c, i)])
    e = lambda c: html_escape(empty(F.col(c)))
    badge = F.concat(F.lit('<span class="badge">'), e("verification"), F.lit("</span>"))
    struck = empty(F.col("superseded_by")) != ""
    statement = F.when(struck, F.concat(F.lit("<s>"), e("statement"), F.lit("</s>"))).otherwise(e("statement"))
    line = F.concat(F.lit("<li>"), statement, F.lit(" "), badge, F.lit(" <cite>"), html_escape(cite()), F.lit("</cite><blockquote>"), e("quote"), F.lit("</blockquote>"),
        F.array_join(F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.concat(F.lit("<p>Check: "), html_escape(w), F.lit("</p>"))), ""), F.lit("</li>"))
    return items.select("package_id", F.element_at(order, category(F.col("kind"))).alias("section"), "seq", line.alias("line"))


def json_rows(items: DataFrame) -> DataFrame:
    """(package_id, seq, json): each item as a JSON object; written by ``df.write.partitionBy("package_id").text``."""
    fields = [c for c in ITEM_FIELDS if c in items.columns]
    return items.select("package_id", "seq", F.to_json(F.struct(*fields)).alias("json"))


def write(lines: DataFrame, path: str) -> None:
    """Lines (package_id, part, section, seq, nth, line) as text files, a folder for each package, in order."""
    ordered = lines.repartition("package_id").sortWithinPartitions("package_id", "part", "section", "seq", "nth")
    ordered.select("package_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("package_id").text(path)
