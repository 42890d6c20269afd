"""Queries of the numbered problems over the test tables, and SQL where whole tables allow it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.llm import leaks, mixing, pieces, pii, plain, residue, similar, truncated
from bidweave.operators import quotes
from bidweave.session import shared_folder
from bidweave.sources.tables import records, table


#: Where the queries look for a tokenizer, unless ``spark.bidweave.vocabulary`` names another file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _near_items(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    return similar.near_duplicates(table(spark, directory, "items"), "seq", "statement", "quote", threshold=0.7)


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """All pairs of items, those inside classes of equal word sets and between linked classes."""
    return similar.expanded(*_near_items(spark, directory)).select(F.col("a").alias("seq_a"), F.col("b").alias("seq_b"))


def p1_groups(spark: SparkSession, directory: str) -> DataFrame:
    """Each item with its class of equal word sets, the number of classes linked to it, and its group of linked classes."""
    links, members = _near_items(spark, directory)
    links = similar.written(links, "links")
    groups = similar.components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rid")).groupBy("rid").agg(F.count("*").alias("links"))
    both = members.join(groups.withColumnRenamed("node", "rid"), "rid", "left").join(degree, "rid", "left")
    return both.select(F.col("key").alias("seq"), F.col("rid").alias("class_seq"), F.coalesce("root", "rid").alias("group_seq"), F.coalesce("links", F.lit(0)).alias("links"))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    cut, _ = truncated.truncated(table(spark, directory, "items"), "seq", "model", ["statement", "quote"])
    return cut.select(F.col("key").alias("seq"), F.col("field").alias("field_name"))


def p2_reasons(spark: SparkSession, directory: str) -> DataFrame:
    """By model and field: how many values were cut, by the evidence that shows it."""
    cut, _ = truncated.truncated(table(spark, directory, "items"), "seq", "model", ["statement", "quote"])
    return cut.groupBy(F.col("source").alias("model"), F.col("field").alias("field_name"), "reason").agg(F.count("*").alias("values"))


def p2_rates(spark: SparkSession, directory: str) -> DataFrame:
    """How often each model's values and items were cut."""
    cut, values = truncated.truncated(table(spark, directory, "items"), "seq", "model", ["statement", "quote"])
    return truncated.rates(cut, values).withColumnRenamed("source", "model")


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    found = pii.details(table(spark, directory, "items"), "seq", ["statement", "quote"])
    return found.select(F.col("key").alias("seq"), F.col("field").alias("field_name"), F.explode("types").alias("pii_type")).distinct()


def p3_redacted(spark: SparkSession, directory: str) -> DataFrame:
    """Statement and quote of every item with placeholders in place of details, and where these stood."""
    items = table(spark, directory, "items").where("seq IS NOT NULL")
    found = pii.details(items, "seq", ["statement", "quote"]).dropDuplicates(["key", "field"])
    by = found.groupBy("key").pivot("field", ["statement", "quote"]).agg(F.first("redacted").alias("text"), F.first("spans").alias("spans"))
    one = items.select("seq", "statement", "quote").dropDuplicates(["seq"])
    return one.join(by, one["seq"] == by["key"], "left").select(
        "seq", F.coalesce("statement_text", "statement").alias("statement"), F.coalesce("quote_text", "quote").alias("quote"), "statement_spans", "quote_spans")


def _pages_and_chunks(spark: SparkSession, directory: str) -> DataFrame:
    pages = table(spark, directory, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "text")
    chunks = table(spark, directory, "chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), "text")
    return pages.unionByName(chunks)


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    ranges = pieces.cell_ranges(_pages_and_chunks(spark, directory))
    cut = pieces.piece_offsets(ranges)
    return cut.select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id")).distinct()


def p4_pieces(spark: SparkSession, directory: str) -> DataFrame:
    """The pieces themselves."""
    cut = pieces.split_texts(_pages_and_chunks(spark, directory))
    return cut.withColumnsRenamed({"kind": "record_kind", "id": "record_id"})


def p4_files(spark: SparkSession, directory: str) -> DataFrame:
    """The pages of each role and package as text files in the shared folder, cut by byte ranges: the pieces of each file."""
    base = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    lines = records(spark, directory, "pages").where("text <> ''").select("package_id", "doc_id", "page", F.regexp_replace("text", "\r", "").alias("value"))
    lines.repartition("package_id").sortWithinPartitions("package_id", "doc_id", "page").select("package_id", "value").write.partitionBy("package_id").text(base)
    files = similar.written(pieces.listed(spark, base).where(F.col("path").endswith(".txt")), "files")
    ranges = pieces.file_ranges(files)
    cut = pieces.emit(ranges, pieces.piece_offsets(ranges))
    named = files.select("id", F.regexp_extract("path", r"package_id=([^/]+)/", 1).alias("package_id"))
    return cut.join(named, "id").groupBy("package_id").agg(F.count("*").alias("pieces"), F.max(F.length("text")).alias("longest"), F.max("stop").alias("chars"), F.count_if(F.col("level") < 5).alias("at_breaks"))


def _quotes_and_pages(spark: SparkSession, directory: str) -> DataFrame:
    quotes = table(spark, directory, "items").select(F.lit("item").alias("kind"), F.col("seq").alias("id"), F.col("quote").alias("text"))
    pages = table(spark, directory, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "text")
    return quotes.unionByName(pages)


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    forms = plain.to_plain(_quotes_and_pages(spark, directory))
    return forms.where("plain <> text AND id IS NOT NULL").select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id")).distinct()


def p5_plain(spark: SparkSession, directory: str) -> DataFrame:
    """Both fields in their plain form, one row for each record."""
    forms = plain.to_plain(_quotes_and_pages(spark, directory))
    return forms.dropDuplicates(["kind", "id"]).select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id"), "plain", (F.col("plain") != F.col("text")).alias("changed"))


def p5_located(spark: SparkSession, directory: str) -> DataFrame:
    """Quotes that had to change, or stand on a document with pages that had to: whether they are found on a page of their
    document in the form they came in, and in plain form."""
    items = records(spark, directory, "items").select("seq", F.col("document").alias("doc_id"), F.col("page").alias("cited"), F.col("quote").alias("text"))
    pages = records(spark, directory, "pages").select("page_id", "doc_id", "page", "text")
    forms = similar.written(plain.to_plain(items.select(F.lit("item").alias("kind"), F.col("seq").alias("id"), "text").unionByName(pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "text"))), "plain")
    changed = forms.where("plain <> text").select("kind", "id")
    own = forms.where("kind = 'item'").select(F.col("id").alias("seq"), "text", "plain").join(items.drop("text"), "seq")
    held = forms.where("kind = 'page'").select(F.col("id").alias("page_id"), "text", "plain").join(pages.drop("text"), "page_id")
    documents = held.join(changed.where("kind = 'page'").select(F.col("id").alias("page_id")), "page_id", "left_semi").select("doc_id")
    documents = documents.union(own.join(changed.where("kind = 'item'").select(F.col("id").alias("seq")), "seq", "left_semi").select("doc_id")).distinct()
    own, held = own.join(documents, "doc_id", "left_semi"), held.join(documents, "doc_id", "left_semi")
    # letter for letter but for white space at breaks of lines
    form = lambda c: F.regexp_replace(F.col(c), r"[ \t\r\n]+", " ")

    def found(c: str) -> DataFrame:
        return quotes.exact(own.select("seq", "doc_id", "cited", form(c).alias("key")).where("key <> ''"), held.select("doc_id", "page", form(c).alias("sq"))).select("seq", F.lit(True).alias(c))

    both = own.select("seq").join(found("text"), "seq", "left").join(found("plain"), "seq", "left")
    return both.select("seq", F.coalesce("text", F.lit(False)).alias("before"), F.coalesce("plain", F.lit(False)).alias("after"))


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    found = leaks.leaks(table(spark, directory, "documents"), table(spark, directory, "eval_items"))
    return found.where("passage_distance = 0").select("doc_id", "item_id").distinct()


def p6_leaked_items(spark: SparkSession, directory: str) -> DataFrame:
    """The items given away: by how many documents, wholly (within the error budget) or in part."""
    found = leaks.leaks(table(spark, directory, "documents"), table(spark, directory, "eval_items"))
    whole = F.col("edit_distance") <= F.col("error_budget")
    return found.where((F.col("passage_distance") == 0) | whole).groupBy("item_id").agg(
        F.count("*").alias("documents"), F.count_if(whole).alias("whole"), F.max("longest_run").alias("longest_run"), F.min("edit_distance").alias("least_distance"))


def _mixed(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Documents of packages and others are the domains."""
    docs = table(spark, directory, "documents").withColumn("domain", F.when(F.col("package_id").isNull(), "loose").otherwise("package"))
    return mixing.mix(docs, table(spark, directory, "mix_targets"), vocabulary=spark.conf.get("spark.bidweave.vocabulary", VOCABULARY))


def p7_mixture(spark: SparkSession, directory: str) -> DataFrame:
    return _mixed(spark, directory)[0]


def p7_shares(spark: SparkSession, directory: str) -> DataFrame:
    """The shares really reached."""
    return _mixed(spark, directory)[1]


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return residue.residue(table(spark, directory, "documents")).select("doc_id")


def p8_reasons(spark: SparkSession, directory: str) -> DataFrame:
    """What was found in each document, and in how many of its sentences."""
    return residue.residue(table(spark, directory, "documents"))


def p8_clean(spark: SparkSession, directory: str) -> DataFrame:
    """The corpus without the documents found."""
    docs = table(spark, directory, "documents")
    return residue.without_residue(docs, residue.residue(docs))


QUERIES = {
    "p1_found": p1_found, "p1_groups": p1_groups,
    "p2_found": p2_found, "p2_rates": p2_rates, "p2_reasons": p2_reasons,
    "p3_found": p3_found, "p3_redacted": p3_redacted,
    "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_files": p4_files,
    "p5_found": p5_found, "p5_plain": p5_plain, "p5_located": p5_located,
    "p6_found": p6_found, "p6_leaked_items": p6_leaked_items,
    "p7_mixture": p7_mixture, "p7_shares": p7_shares,
    "p8_found": p8_found, "p8_reasons": p8_reasons, "p8_clean": p8_clean,
}

_ENDS = "regexp_replace(regexp_replace(text, '^[\\s\\x1c-\\x1f\\x0b\\x{85}\\p{Z}]+', ''), '[\\s\\x1c-\\x1f\\x0b\\x{85}\\p{Z}]+$', '')"
_WORDS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"
_GRAMS = "SELECT DISTINCT {k}, unnest(list_transform(range(1, len(w) - 10), lambda n: array_to_string(w[n:n + 11], ' '))) AS g FROM {t}"
SQL: dict[str, str] = {
    "p1_found": f"""
        WITH s AS (SELECT DISTINCT seq, list_distinct({_WORDS.format("coalesce(statement, '') || ' ' || coalesce(quote, '')")}) AS ws FROM items WHERE seq IS NOT NULL),
          t AS (SELECT seq, len(ws) AS n, unnest(ws) AS w FROM s),
          b AS (SELECT x.seq AS seq_a, y.seq AS seq_b, any_value(x.n + y.n) AS n, count(*) AS common FROM t x JOIN t y ON x.w = y.w AND x.seq < y.seq AND x.n >= 0.7 * y.n AND y.n >= 0.7 * x.n GROUP BY 1, 2)
        SELECT seq_a, seq_b FROM b WHERE common >= 0.7 * (n - common) - 1e-9""",
    "p6_found": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM eval_items),
          dg AS ({_GRAMS.format(k="doc_id", t="d")}), ig AS ({_GRAMS.format(k="item_id", t="i")})
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p4_found": f"""
        SELECT DISTINCT 'page' AS record_kind, page_id AS record_id FROM pages WHERE length(text) > 9000 AND length({_ENDS}) > 9000
        UNION ALL SELECT DISTINCT 'chunk', chunk_id FROM chunks WHERE length(text) > 9000 AND length({_ENDS}) > 9000""",
}
