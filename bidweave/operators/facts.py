"""Key facts of a package, and counts over its items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidweave.functions import constants as K
from bidweave.functions.text import empty, has
from bidweave.operators.items import live


def _top(items: DataFrame, *order) -> DataFrame:
    own = Window.partitionBy("package_id").orderBy(*order)
    return items.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")


def first_of(items: DataFrame, kind: str) -> DataFrame:
    return _top(items.where(F.col("kind") == kind), "seq").withColumn("fact", F.lit(kind))


def dated(items: DataFrame, kind: str) -> DataFrame:
    """A deadline: the latest date an amendment gives, else the date most items agree on (the later of equals), else the first item."""
    own = items.where(F.col("kind") == kind)
    has_date = empty(F.col("date")) != ""
    agree = own.where(has_date).groupBy("package_id", "date").agg(F.count("*").alias("__votes"))
    scored = own.join(agree, ["package_id", "date"], "left").withColumn("__amended", has_date & (F.col("role") == "amendment"))
    order = [F.col("__amended").desc(), has_date.desc(), F.when(~F.col("__amended"), F.col("__votes")).desc_nulls_last(), F.when(has_date, F.col("date")).desc_nulls_last(), F.col("seq")]
    return _top(scored, *order).drop("__votes", "__amended").withColumn("fact", F.lit(kind))


def ranked(items: DataFrame, fact: str, kinds: list[str], rank, floor: int) -> DataFrame:
    """The best candidate by ``rank``, the first of equals, if it reaches ``floor``."""
    own = items.where(F.col("kind").isin(kinds)).withColumn("__rank", rank).where(F.col("__rank") >= floor)
    return _top(own, F.desc("__rank"), "seq").drop("__rank").withColumn("fact", F.lit(fact))


def key_facts(items: DataFrame) -> DataFrame:
    """One row for each package and fact found, ``fact`` naming it; the order of items is ``seq``. ``evaluation_factors`` has
    a row for each of a package's factors. Superseded and rejected items are no facts."""
    kept = live(items).where(~F.col("verification").eqNullSafe("missing"))
    text = F.concat_ws(" ", empty(F.col("statement")), empty(F.col("quote")))
    one = lambda c, n=1: F.when(c, n).otherwise(0)
    submission = one(has(text, K.CHANNEL_WORDS), 2) + one(has(text, K.RESPONSE_WORDS), 2) + one(F.col("kind") == "submission_method") - one(has(empty(F.col("statement")), K.NOT_THE_RESPONSE), 4)
    award = one(F.contains(F.lower(text), F.lit("award")), 2) + one(F.lower(text).rlike(K.AWARD_WORDS))
    parts = [
        dated(kept, "response_due"), dated(kept, "questions_due"), ranked(kept, "submission_method", ["submission_method", "response_due"], submission, 3), first_of(kept, "page_limit"),
        ranked(kept, "basis_of_award", ["basis_of_award"], award, 0), first_of(kept, "set_aside"), first_of(kept, "naics"),
        kept.where("kind = 'evaluation_factor'").withColumn("fact", F.lit("evaluation_factors")),
    ]
    return reduce(DataFrame.unionByName, parts)


def stats(items: DataFrame) -> DataFrame:
    """Counts of each package's items by state."""
    gone = empty(F.col("superseded_by")) != ""
    missing = F.col("verification") == "missing"
    n = lambda c: F.count_if(c)
    return items.groupBy("package_id").agg(
        n(~gone & ~F.coalesce(missing, F.lit(False))).alias("kept"), n(gone).alias("superseded"), n(missing).alias("rejected"), n(F.col("verification") == "exact").alias("exact"),
        n(F.col("verification") == "fuzzy").alias("fuzzy"), n(F.col("verification") == "assembled").alias("assembled"), n(F.size("warnings") > 0).alias("warnings"))
