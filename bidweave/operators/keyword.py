"""The keyword baseline: facts and obligations by patterns alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.functions import constants as K
from bidweave.functions import dates as D
from bidweave.functions.text import has, sentences
from bidweave.session import written


def page_sentences(pages: DataFrame) -> DataFrame:
    """(package_id, document, doc_order, role, page, nth, text): the sentences of pages' layout texts. ``doc_order``, where pages
    have it, is the place of the document among those given."""
    order = F.col("doc_order") if "doc_order" in pages.columns else F.lit(None).cast("int")
    return pages.select("package_id", F.col("doc_id").alias("document"), order.alias("doc_order"), "role", "page", F.posexplode(sentences(F.col("text"))).alias("nth", "text"))


def flags(text: Column) -> dict[str, Column]:
    """Every keyword predicate on a sentence."""
    return {k: has(text, p) for k, p in K.KEYWORDS.items()}


def flagged(pages: DataFrame) -> DataFrame:
    s = page_sentences(pages)
    return s.withColumns(flags(F.col("text")))


def baseline(pages: DataFrame) -> DataFrame:
    """(package_id, kind, statement, quote, page, document, role, date, time, weight): the first sentence for each fact,
    amendments before other documents, each in the order given (by id where none is), and every sentence that names points or an obligation.

    The first dated question sentence is the questions deadline; the response deadline is the first other dated sentence
    that names a response.
    """
    s = flagged(pages).withColumn("dates", D.find_dates(F.col("text"))).withColumn("times", D.find_times(F.col("text")))
    # read three times below; written once, no pattern is tried twice on a sentence
    s = written(s.withColumn("at", F.struct((F.col("role") != "amendment").alias("later"), F.col("doc_order").isNull().alias("unknown"), "doc_order", "document", "page", "nth")), "sentences")
    is_dated = F.size("dates") > 0
    asks = is_dated & F.col("questions") & F.col("due")
    answers = is_dated & F.col("due") & F.col("response")
    simple = {
        "submission_method": F.col("submit") & F.col("channel"), "page_limit": F.col("page_limit") & F.col("limit_word"), "basis_of_award": F.col("basis"),
        "set_aside": F.col("set_aside"), "naics": F.col("naics"),
    }
    row = F.struct("at", "text", "page", "document", "role", "dates", "times")
    two = F.min(F.when(answers, row))  # the first answer; another is needed where the first question takes it
    per = s.groupBy("package_id").agg(
        F.min(F.when(asks, row)).alias("questions_due"), two.alias("__r1"), F.min(F.when(answers & ~asks, row)).alias("__plain"), *[F.min(F.when(c, row)).alias(k) for k, c in simple.items()])
    # among answering questions the first may be the questions deadline itself, so the second counts
    both = s.where(asks & answers).join(per.select("package_id", F.col("questions_due.at").alias("__q")), "package_id").where("at > __q").groupBy("package_id").agg(F.min(row).alias("__second"))
    per = per.join(both, "package_id", "left").withColumn("response_due", F.when(F.col("__r1.at") == F.col("questions_due.at"), F.least("__plain", "__second")).otherwise(F.col("__r1")))
    base = F.lit("base")

    def fact(kind: str, with_date: bool) -> DataFrame:
        own = per.where(F.col(kind).isNotNull()).select("package_id", F.col(kind).alias("f"))
        date = F.coalesce(F.get(F.col("f.dates"), F.lit(0)), F.lit("")) if with_date else F.lit("")
        time = F.coalesce(F.get(F.col("f.times"), F.lit(0)), F.lit("")) if with_date else F.lit("")
        return own.select("package_id", F.lit(kind).alias("kind"), F.col("f.text").alias("text"), F.col("f.page").alias("page"), F.col("f.document").alias("document"), (F.col("f.role") if with_date else base).alias("role"), date.alias("date"), time.alias("time"), F.lit("").alias("weight"))

    rated = F.col("points") & F.col("evaluation")
    listed = s.where(rated | F.col("obligation")).select(
        "package_id", F.when(rated, "evaluation_factor").otherwise("required_content").alias("kind"), "text", "page", "document", base.alias("role"), F.lit("").alias("date"), F.lit("").alias("time"),
        F.when(rated, F.regexp_extract("text", "(?iU)" + K.KEYWORDS["points"], 0)).otherwise("").alias("weight"))
    every = reduce(DataFrame.unionByName, [listed, fact("response_due", True), fact("questions_due", True), *[fact(k, False) for k in simple]])
    return every.select("package_id", "kind", F.substring("text", 1, 220).alias("statement"), F.substring("text", 1, 400).alias("quote"), "page", "document", "role", "date", "time", "weight")
