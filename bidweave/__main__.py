"""``python -m bidweave COMMAND BASE.txt [--amendment A.txt]... [--attachment B.txt]... --out DIR`` over page texts.

``baseline`` writes what keywords find as JSON lines. ``analyze`` asks a provider (``--provider module:name``, any object with
``name``, ``model`` and ``complete``) for the items of each chunk, verifies and merges them, and writes reports.
"""

from __future__ import annotations

import argparse
import datetime
import importlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave.operators import items, keyword, pages, redaction, replies, reports
from bidweave.plans import pipeline
from bidweave.session import local_session, written
from bidweave.sources import files


def analyze(texts: DataFrame, provider: replies.Provider, title: str, out: str, cache: str = "", redact: bool = False) -> None:
    """Reports of one package, whose ``texts`` are (package_id, doc_id, doc_order, role, page, text)."""
    spark = texts.sparkSession
    began = datetime.datetime.now(datetime.timezone.utc)
    texts = written(texts.withColumn("reading", F.lit("")), "texts")
    if cache:
        replies.keep(spark.createDataFrame([], replies.ENTRY), cache)  # so that there is one
    answers, entries = replies.ask(pages.chunk_texts(texts), provider, replies.kept(spark, cache) if cache else None)
    answers = written(answers, "answers")
    if cache:
        replies.keep(entries, cache)
    documents = texts.groupBy("package_id", F.col("doc_id").alias("id"), "role").agg(F.min("doc_order").alias("doc_order"), F.count("*").alias("pages"))
    found = items.coerce(answers.where("reply IS NOT NULL").withColumnRenamed("page", "asked")).join(documents.withColumnRenamed("id", "doc_id"), "doc_id")
    # the order of extraction as a number: document, chunk, page, place in the reply
    seq = ((F.col("doc_order").cast("long") * 100_000 + F.col("chunk_idx")) * 100_000 + F.coalesce("asked", F.lit(0))) * 10_000 + F.col("idx")
    raw = found.withColumn("seq", seq).withColumnRenamed("doc_id", "document").withColumns({"verification": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double"), "end_page": F.lit(None).cast("int")})
    raw = written(raw.drop("idx", "chunk_idx", "asked", "key", "error", "hit", "doc_order", "pages"), "raw")
    done = pipeline.analyze(raw, texts)
    if redact:
        done = pipeline.cleaned(done, texts)
    package = spark.createDataFrame([("package", title, None)], "package_id string, title string, base string").join(
        documents.where("role = 'base'").select("package_id", F.col("id").alias("__b")), "package_id", "left").withColumn("base", F.col("__b")).drop("__b")
    manifest = documents.select("id", files.title_of(F.col("id")).alias("title"), F.lit("").alias("short"))
    created = began.isoformat(timespec="seconds")
    titled = lambda df: reports.with_titles(df, package, manifest)
    head = reports.headed(package, manifest)
    reports.write(pipeline.report(done, package, manifest, created[:10], provider.model), out + "/markdown")
    reports.write(reports.html_page(titled(done.items), titled(done.facts), head, done.stats, done.rejected, provider.model), out + "/html")
    lost = replies.errors(answers).join(documents.withColumnRenamed("id", "doc_id"), "doc_id").select("package_id", "error")
    seconds = round((datetime.datetime.now(datetime.timezone.utc) - began).total_seconds(), 1)
    run = {"created": created, "model": provider.model, "provider": provider.name, "seconds": seconds}
    listed = documents.join(manifest.withColumn("short", F.col("title")), "id")
    reports.write(reports.json_report(done.items, done.rejected, done.facts, head, listed, done.stats, lost, run), out + "/json")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="bidweave")
    p.add_argument("command", choices=["baseline", "analyze"])
    p.add_argument("base")
    p.add_argument("--amendment", action="append", default=[])
    p.add_argument("--attachment", action="append", default=[])
    p.add_argument("--title", default="")
    p.add_argument("--out", required=True)
    p.add_argument("--provider", default="")
    p.add_argument("--cache", default="")
    p.add_argument("--redact-contacts", action="store_true")
    a = p.parse_args(argv)
    spark = local_session()
    parts = [(a.base, "base"), *((x, "amendment") for x in a.amendment), *((x, "attachment") for x in a.attachment)]
    texts = reduce(DataFrame.unionByName, [files.page_texts(spark, path).withColumn("role", F.lit(role)).withColumn("doc_order", F.lit(n)) for n, (path, role) in enumerate(parts)])
    if a.command == "analyze":
        module, _, name = a.provider.partition(":")
        analyze(texts.withColumn("package_id", F.lit("package")), getattr(importlib.import_module(module), name), a.title, a.out, a.cache, a.redact_contacts)
        return
    found = keyword.baseline(texts.withColumn("package_id", F.lit(a.title or "package")))
    if a.redact_contacts:
        for column in ("statement", "quote"):
            found = redaction.redact(found, column)
    found.write.mode("overwrite").json(a.out)


if __name__ == "__main__":
    main()
