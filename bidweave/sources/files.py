"""Sources of files: page texts, JSON manifests and answers, uploads, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.functions.text import empty, file_name
from bidweave.operators.pages import split_pages

MANIFEST = (
    "documents array<struct<id string, title string, issuer string, kind string, file string, url string, page string, short string, amends string, attachment_of string>>, "
    "packages array<struct<id string, title string, base string, amendments array<string>, attachments array<string>>>"
)
GOLD = (
    "facts map<string, struct<date string, time string, any array<string>, page int>>, evaluation_factors array<struct<name array<string>, weight string>>, "
    "checklist array<struct<id string, text string, all array<array<string>>>>"
)


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page, text) of text files whose pages end with form feeds; the file's stem is the document."""
    raw = spark.read.text(path, wholetext=True).select(stem(F.input_file_name()).alias("doc_id"), F.col("value").alias("text"))
    return split_pages(raw)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def title_of(path: Column) -> Column:
    """A title from a file's name: hyphens and underscores as spaces."""
    return F.translate(stem(path), "-_", "  ")


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(documents, packages)`` of JSON manifests."""
    raw = spark.read.json(path, schema=MANIFEST, multiLine=True)
    documents = raw.select(F.explode("documents").alias("d")).select("d.*")
    packages = raw.select(F.explode("packages").alias("p")).select(F.col("p.id").alias("package_id"), "p.title", "p.base", "p.amendments", "p.attachments")
    return documents, packages


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Reference answers, one JSON file a package."""
    return spark.read.json(path, schema=GOLD, multiLine=True).withColumn("package_id", stem(F.input_file_name()))


def checksums(spark: SparkSession, path: str, ledger: DataFrame | None = None) -> DataFrame:
    """(doc_id, sha256, is_pdf, changed) of files; ``changed`` against a ledger (doc_id, sha256), NULL where it has none."""
    files = spark.read.format("binaryFile").load(path)
    own = files.select(stem(F.col("path")).alias("doc_id"), F.sha2("content", 256).alias("sha256"), (F.hex(F.substring("content", 1, 4)) == "25504446").alias("is_pdf"))
    if ledger is None:
        return own.withColumn("changed", F.lit(None).cast("boolean"))
    return own.join(ledger.select("doc_id", F.col("sha256").alias("__old")), "doc_id", "left").withColumn("changed", F.col("sha256") != F.col("__old")).drop("__old")


def keep_checksums(sums: DataFrame, path: str) -> None:
    """The ledger that ``checksums`` compares with: (doc_id, sha256) as JSON lines."""
    sums.select("doc_id", "sha256").write.mode("overwrite").json(path)


def kept_checksums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema="doc_id string, sha256 string")


def uploads(requests: DataFrame, most: int = 60 * 1024 * 1024) -> DataFrame:
    """Files of uploads (id, title, files ARRAY<STRUCT<name, role, data>>): decoded, named safely, with a role (attachment
    where it is none), and the error that an upload fails with, if any; ``most`` is the size in bytes up to which one is taken."""
    each = requests.select("id", F.posexplode_outer("files").alias("at", "f"))
    role = F.when(F.col("f.role").isin("base", "amendment", "attachment"), F.col("f.role")).otherwise("attachment")
    data = F.try_to_binary(F.col("f.data"), F.lit("base64"))
    rows = each.select("id", "at", file_name(F.col("f.name")).alias("name"), role.alias("role"), data.alias("data"), (F.coalesce(F.hex(F.substring(data, 1, 4)) == "25504446", F.lit(False))).alias("is_pdf"))
    checked = rows.groupBy("id").agg(F.count("at").alias("n"), F.count_if(F.col("role") == "base").alias("bases"), F.bool_and("is_pdf").alias("pdfs"), F.sum(F.octet_length("data")).alias("bytes"))
    error = F.when(F.col("n") == 0, "no files").when(F.col("bases") != 1, "exactly one base document is needed").when(F.col("bytes") > most, "too large").when(~F.col("pdfs"), "not a PDF")
    return rows.join(checked.select("id", error.alias("error")), "id")


def guessed_role(at: Column, name: Column) -> Column:
    """The role a file is given before anyone says so."""
    return F.when(at == 0, "base").when(empty(name).rlike("(?i)amend|addend|revis"), "amendment").otherwise("attachment")
