"""Scoring found facts, factors and items against reference answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.functions.text import empty, percent
from bidweave.session import written


def _text(prefix: str = "") -> Column:
    return F.lower(F.concat_ws(" ", empty(F.col(prefix + "statement")), empty(F.col(prefix + "quote"))))


def score_facts(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Per package and fact: whether it is right, and the time where one is asked for.

    ``gold`` is (package_id, fact, stated, date, time, any ARRAY<STRING>), ``found`` (package_id, fact, statement, quote, date,
    time). A fact that isn't stated is right only if none was found; a date must be equal; otherwise one of the accepted
    phrases must occur.
    """
    f = found.select("package_id", "fact", "statement", "quote", F.col("date").alias("got_date"), F.col("time").alias("got_time"), F.lit(True).alias("there"))
    both = gold.join(f, ["package_id", "fact"], "full")
    stated, there = F.coalesce("stated", F.lit(False)), F.coalesce("there", F.lit(False))
    is_date = empty(F.col("date")) != ""
    phrase = F.coalesce(F.exists("any", lambda a: F.contains(_text(), a)), F.lit(False))
    correct = F.when(~stated, ~there).when(~there, F.lit(False)).when(is_date, empty(F.col("got_date")) == F.col("date")).otherwise(phrase)
    timed = stated & there & is_date & (empty(F.col("time")) != "")
    expected = F.when(~stated, "not stated").when(is_date, F.col("date")).when(~there, F.array_join("any", "/")).otherwise(F.array_join("any", " | "))
    got = F.when(~there, F.when(stated, "not found").otherwise("not stated")).when(stated & is_date, F.coalesce(F.nullif("got_date", F.lit("")), F.lit("no date"))).otherwise(F.col("statement"))
    return both.select("package_id", "fact", correct.alias("correct"), F.when(timed, empty(F.col("got_time")) == F.col("time")).alias("time_correct"), expected.alias("expected"), got.alias("got"))


def _meetings(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(line, text): all pairs of a package in which the text can satisfy the line, and others. ``lines`` is (package_id,
    line, groups ARRAY<ARRAY<STRING>>), ``texts`` (package_id, text, t).

    A text that contains a phrase has a word that contains the phrase's longest run of letters and digits. Lines meet the
    texts with such words for one of their groups, the one with fewest; phrases without a run meet all texts of the package.
    """
    words_ = F.array_union(F.array_distinct(F.filter(F.split("t", "[^a-z0-9]+"), lambda w: w != "")), F.array(F.lit("")))
    word = written(texts.select("package_id", "text", F.explode(words_).alias("word")), "words")
    often = word.groupBy("package_id", "word").agg(F.count("*").alias("texts"))
    # no groups at all are satisfied by any text
    groups = F.when(F.size("groups") > 0, F.col("groups")).otherwise(F.array(F.array(F.lit(""))))
    phrase = lines.select("package_id", "line", F.posexplode(groups).alias("nth", "g")).select("package_id", "line", "nth", F.explode("g").alias("p")).where("p IS NOT NULL")
    runs = F.array_sort(F.transform(F.filter(F.split("p", "[^a-z0-9]+"), lambda r: r != ""), lambda r: F.struct((-F.length(r)).alias("l"), r.alias("r"))))
    phrase = written(phrase.select("package_id", "line", "nth", F.coalesce(F.try_element_at(runs, F.lit(1))["r"], F.lit("")).alias("run")).distinct(), "phrases")
    # which words contain which runs doesn't depend on packages: joined by the run's beginning, for words of all packages once
    run, known = phrase.select("run").distinct(), word.select("word").distinct()
    head = lambda n: F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.substring(F.col("word"), i, F.lit(n)))
    parts = F.array_distinct(F.concat(*[F.when(F.length("word") >= n, head(n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)]))
    holds = known.select("word", F.explode(parts).alias("part")).join(run.select("run", F.substring("run", 1, 3).alias("part")), "part").where(F.contains("word", "run")).select("run", "word")
    holds = holds.unionByName(run.where("run = ''").select("run", F.lit("").alias("word")))
    reach = written(phrase.join(holds, "run", "left").select("package_id", "line", "nth", "word").distinct().join(often, ["package_id", "word"], "left"), "reach")
    least = reach.groupBy("package_id", "line", "nth").agg(F.sum(F.coalesce("texts", F.lit(0))).alias("n")).groupBy("package_id", "line").agg(F.min_by("nth", F.struct("n", "nth")).alias("nth"))
    return reach.join(least, ["package_id", "line", "nth"]).join(word, ["package_id", "word"]).select("line", "text").distinct()


def _numbered(df: DataFrame, column: str) -> DataFrame:
    """Distinct rows with a number, fixed by being written."""
    return written(df.distinct().withColumn(column, F.monotonically_increasing_id()), column)


def score_checklist(gold: DataFrame, items: DataFrame) -> DataFrame:
    """(package_id, id, found): whether some item of the package satisfies every group of a checklist line, by any of the
    group's phrases. ``gold`` is (package_id, id, all ARRAY<ARRAY<STRING>>)."""
    texts = _numbered(items.select("package_id", _text().alias("t")), "text")
    lines = _numbered(gold.select("package_id", F.col("all").alias("groups")), "line")
    covers = F.forall("groups", lambda g: F.exists(g, lambda a: F.contains(F.col("t"), a)))
    return _found(gold.select("package_id", "id", F.col("all").alias("groups")), lines, texts, covers, ["groups"])


def score_factors(gold: DataFrame, factors: DataFrame) -> DataFrame:
    """(package_id, id, found): whether some factor has one of the names, and the weight where one is asked for. ``gold`` is
    (package_id, id, names ARRAY<STRING>, weight)."""
    texts = _numbered(factors.select("package_id", _text().alias("t"), F.concat_ws(" ", empty(F.col("weight")), _text()).alias("wt")), "text")
    g = gold.select("package_id", "id", "names", F.col("weight").alias("asked"))
    lines = _numbered(g.drop("id"), "line").withColumn("groups", F.array("names"))
    hit = F.exists("names", lambda n: F.contains(F.col("t"), n)) & (F.col("asked").isNull() | F.contains(F.col("wt"), F.col("asked")))
    return _found(g, lines, texts, hit, ["names", "asked"])


def _found(gold: DataFrame, lines: DataFrame, texts: DataFrame, hit: Column, by: list[str]) -> DataFrame:
    """Gold rows with whether a text hits their line; lines that are equal in ``by`` are looked for once."""
    met = _meetings(lines.select("package_id", "line", "groups"), texts.select("package_id", "text", "t"))
    hits = met.join(lines, "line").join(texts.drop("package_id"), "text").where(hit).select("line").distinct()
    same = lines.join(hits, "line").select(F.col("package_id").alias("__p"), *[F.col(c).alias("__" + c) for c in by], F.lit(True).alias("found"))
    on = [F.col("package_id") == F.col("__p"), *[F.col(c).eqNullSafe(F.col("__" + c)) for c in by]]
    return gold.join(same, on, "left").select("package_id", "id", F.coalesce("found", F.lit(False)).alias("found"))


def totals(scores: DataFrame) -> DataFrame:
    """Right and asked-for facts and times, for each package and (package_id NULL) over all."""
    return scores.rollup("package_id").agg(
        F.count_if("correct").alias("facts_correct"), F.count("*").alias("facts_total"), F.count_if("time_correct").alias("times_correct"), F.count("time_correct").alias("times_total"))


def verdict(score: DataFrame) -> DataFrame:
    """Scored facts with what a table of results says of them: ``yes``, ``date only``, ``no``."""
    label = F.when(F.col("correct") & F.coalesce("time_correct", F.lit(True)), "yes").when(F.col("correct"), "date only").otherwise("no")
    return score.withColumn("verdict", label)


def results(facts: DataFrame, factors: DataFrame, checklist: DataFrame, items: DataFrame) -> DataFrame:
    """One row a package and one (package_id NULL) over all: right and asked-for facts and times, factors and checklist lines
    found, and the number of live items. The arguments are the scores of facts, factors and checklist, and the items."""
    n = lambda **c: {k: c.get(k, F.lit(None).cast("boolean")) for k in ("fact", "timed", "factor", "line", "item")}
    part = lambda df, **c: df.select("package_id", *[x.alias(k) for k, x in n(**c).items()])
    every = part(facts, fact=F.col("correct"), timed=F.col("time_correct")).unionByName(part(factors, factor=F.col("found"))).unionByName(part(checklist, line=F.col("found"))).unionByName(
        part(items.where(empty(F.col("superseded_by")) == ""), item=F.lit(True)))
    names = (("fact", "facts_correct", "facts_total"), ("timed", "times_correct", "times_total"), ("factor", "factors_found", "factors_total"), ("line", "checklist_found", "checklist_total"))
    counts = [x for c, right, total in names for x in (F.count_if(c).alias(right), F.count(c).alias(total))]
    return every.rollup("package_id").agg(*counts, F.count("item").alias("items"))


def missed(checklist: DataFrame, lines: DataFrame) -> DataFrame:
    """(package_id, id, text) of checklist lines that no item covers; ``lines`` is (package_id, id, text)."""
    return lines.join(checklist.where("NOT found").select("package_id", "id"), ["package_id", "id"], "left_semi").select("package_id", "id", "text")


def gold_facts(gold: DataFrame) -> DataFrame:
    """(package_id, fact, stated, date, time, any) of reference answers as ``sources.files.gold`` reads them; a fact without a
    value isn't stated."""
    g = gold.select("package_id", F.explode("facts").alias("fact", "v"))
    return g.select("package_id", "fact", F.col("v").isNotNull().alias("stated"), "v.date", "v.time", "v.any")


def gold_factors(gold: DataFrame) -> DataFrame:
    """(package_id, id, names, weight) of reference answers."""
    return gold.select("package_id", F.posexplode("evaluation_factors").alias("id", "f")).select("package_id", "id", F.col("f.name").alias("names"), "f.weight")


def gold_checklist(gold: DataFrame) -> DataFrame:
    """(package_id, id, text, all) of reference answers."""
    return gold.select("package_id", F.explode("checklist").alias("c")).select("package_id", "c.id", "c.text", "c.all")


MEASURES = {
    "Key facts right": ("facts_correct", "facts_total"), "Deadline times right": ("times_correct", "times_total"), "Evaluation factors found": ("factors_found", "factors_total"),
    "Must-do checklist items covered": ("checklist_found", "checklist_total")}


def table(first: DataFrame, second: DataFrame) -> DataFrame:
    """(package_id, nth, line): Markdown tables of two results side by side, for each package and (NULL) over all."""
    both = first.select("package_id", F.struct(*[c for c in first.columns if c != "package_id"]).alias("a")).join(
        second.select(F.col("package_id").alias("__p"), F.struct(*[c for c in second.columns if c != "package_id"]).alias("b")), F.col("package_id").eqNullSafe(F.col("__p")))
    cell = lambda x, right, total: percent(F.col(f"{x}.{right}"), F.col(f"{x}.{total}"))
    rows = [F.concat(F.lit(f"| {k} | "), cell("a", *v), F.lit(" | "), cell("b", *v), F.lit(" |")) for k, v in MEASURES.items()]
    rows.append(F.concat(F.lit("| Items returned | "), F.col("a.items").cast("string"), F.lit(" | "), F.col("b.items").cast("string"), F.lit(" |")))
    head = [F.lit("| Measure | Model | Keyword baseline |"), F.lit("|---|---:|---:|")]
    return both.select("package_id", F.posexplode(F.array(*head, *rows)).alias("nth", "line"))
