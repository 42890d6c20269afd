"""Asking a model for chunks' items, with replies kept by the request's key."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.session import written

#: How a reply that passed its budget is kept.
TOO_LONG = "too_long"
ENTRY = "key string, reply string, error string"


class TooLong(Exception):
    """The reply would pass the budget."""


class Provider(Protocol):
    """Whatever answers prompts; it is pickled and used inside tasks."""

    name: str
    model: str

    def complete(self, system: str, user: str, schema: str, budget: int) -> str: ...


def key(provider: Provider, system: str, user: Column, schema: str) -> Column:
    """The content key of a request: provider, model, both prompts and the schema of the reply. The budget isn't part of it."""
    fixed = lambda x: F.lit(x).cast("string")
    return F.sha2(F.to_json(F.array(fixed(provider.name), fixed(provider.model), fixed(system), user, fixed(schema))), 256)


def prompt(title: Column, first: Column, last: Column, text: Column) -> Column:
    """What is asked of a chunk."""
    return F.concat(F.lit("Document: "), title, F.lit("\nPages "), first.cast("string"), F.lit(" to "), last.cast("string"), F.lit("\n\n"), text)


def _answers(wanted: DataFrame, provider: Provider, system: str, schema: str, cache: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """``(answers, fresh)`` of requests (id columns, user, key): each with its reply, error and whether it was a hit. A key that
    the cache lacks is asked once, by its first request; its other requests are hits."""
    known = cache.select("key", "reply", "error").dropDuplicates(["key"])
    ids = [c for c in wanted.columns if c not in ("user", "key")]
    new = wanted.join(known, "key", "left_anti").groupBy("key").agg(F.min(F.struct(*ids)).alias("first"), F.first("user").alias("user"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for user in b["user"]:
                try:
                    out.append((provider.complete(system, user, schema, budget), None))
                except TooLong:
                    out.append((None, TOO_LONG))
                except Exception as e:  # an answer that fails is a row, not a lost task
                    out.append((None, str(e)[:400] or type(e).__name__))
            b["reply"], b["error"] = [r for r, _ in out], [e for _, e in out]
            yield b[["key", "reply", "error"]]

    # written: a provider is asked once for a request, however often the answers are read
    fresh = written(new.select("key", "user").mapInPandas(run, ENTRY), "replies")
    first = new.select("key", F.col("first").alias("__first"))
    both = wanted.join(fresh.unionByName(known), "key").join(first, "key", "left")
    hit = ~F.coalesce(F.col("__first") == F.struct(*ids), F.lit(False))
    return both.select(*ids, "key", "reply", "error", hit.alias("hit")), fresh


def ask(chunks: DataFrame, provider: Provider, cache: DataFrame | None = None, budget: int = 4000, system: str = "", schema: str = "") -> tuple[DataFrame, DataFrame]:
    """``(answers, entries)`` for chunks (doc_id, chunk_idx, pages, text with page markers).

    Requests whose key the cache (key, reply, error) holds aren't repeated. A chunk whose reply is too long is asked for page
    by page with twice the budget; a page that is a chunk of its own is the same request and stays too long, as the key has
    no budget. ``answers`` is (doc_id, chunk_idx, page, key, reply, error, hit), ``page`` being NULL for a
    whole chunk; ``error`` says which pages are lost and why, and is ``too_long`` for a chunk that was asked for by page.
    ``entries`` is what the cache lacks: replies, and requests known to be too long; other failures aren't kept.
    """
    spark = chunks.sparkSession
    cache = spark.createDataFrame([], ENTRY) if cache is None else cache
    c = chunks.where("size(pages) > 0").select("doc_id", "chunk_idx", "pages", "text")
    place = F.col("doc_id"), F.element_at("pages", 1), F.element_at("pages", -1)
    whole = c.select("doc_id", "chunk_idx", F.lit(None).cast("int").alias("page"), prompt(*place, F.col("text")).alias("user"))
    whole = whole.withColumn("key", key(provider, system, F.col("user"), schema))
    one, fresh = _answers(whole, provider, system, schema, cache, budget)
    # the text behind each marker, with its marker, is the page's own request
    over = c.join(one.where(F.col("error") == TOO_LONG).select("doc_id", "chunk_idx"), ["doc_id", "chunk_idx"], "left_semi")
    parts = F.filter(F.split("text", r"(?=<<<PAGE \d+>>>\n)"), lambda t: t != "")
    single = over.select("doc_id", "chunk_idx", F.explode(parts).alias("part")).withColumn("page", F.regexp_extract("part", r"^<<<PAGE (\d+)>>>", 1).try_cast("int"))
    single = single.select("doc_id", "chunk_idx", "page", prompt(F.col("doc_id"), F.col("page"), F.col("page"), F.regexp_replace("part", r"\n+$", "")).alias("user"))
    single = single.withColumn("key", key(provider, system, F.col("user"), schema))
    two, second = _answers(single, provider, system, schema, cache.select("key", "reply", "error").unionByName(fresh), 2 * budget)
    two = two.withColumn("error", F.when(F.col("error").isNotNull(), F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(": "), "error")))
    named = one.join(c.select("doc_id", "chunk_idx", F.concat(F.lit("pages "), place[1].cast("string"), F.lit("-"), place[2].cast("string"), F.lit(": ")).alias("__p")), ["doc_id", "chunk_idx"])
    error = F.when(F.col("error") == TOO_LONG, F.col("error")).when(F.col("error").isNotNull(), F.concat("__p", "error"))
    one = named.withColumn("error", error).select(two.columns)
    entries = fresh.unionByName(second).where((F.col("error").isNull() & F.col("reply").isNotNull()) | (F.col("error") == TOO_LONG))
    return one.unionByName(two), entries


def keep(entries: DataFrame, path: str) -> None:
    """Adds entries to the cache at ``path``, a parquet table."""
    entries.write.mode("append").parquet(path)


def kept(spark, path: str) -> DataFrame:
    """The cache at ``path``."""
    return spark.read.schema(ENTRY).parquet(path)


def counters(answers: DataFrame) -> DataFrame:
    """(requests, hits, misses, too_long, failed) over all answers."""
    failed = F.col("error").isNotNull() & (F.col("error") != TOO_LONG)
    return answers.agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count_if(F.col("error") == TOO_LONG).alias("too_long"), F.count_if(failed).alias("failed"))


def errors(answers: DataFrame) -> DataFrame:
    """(doc_id, error) of what was lost."""
    return answers.where(F.col("error").isNotNull() & (F.col("error") != TOO_LONG)).select("doc_id", "error")
