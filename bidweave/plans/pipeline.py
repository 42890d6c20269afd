"""The whole analysis as one composition of operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave.operators import facts, items, quotes, redaction, reports
from bidweave.operators.pages import searchable
from bidweave.session import written


@dataclass
class Analysis:
    items: DataFrame
    rejected: DataFrame
    facts: DataFrame
    stats: DataFrame


def analyze(raw: DataFrame, pages: DataFrame) -> Analysis:
    """Items as extracted (seq unique, document, quote, page as cited, kind, date, ...) verified against ``pages``
    (doc_id, page, text, reading), their dates checked, kinds corrected, repeats merged and amendments applied; with key
    facts and counts. Items whose quote is on no page are rejected."""
    fresh = raw.withColumns({
        "cited_page": F.col("page"), "warnings": F.array().cast("array<string>"), "also_on": F.array().cast("array<int>"), "superseded_by": F.lit(None).cast("string")})
    kept, rejected = items.verify(fresh, quotes.locate(fresh, pages))
    kept = written(items.reclassify(items.check_dates(kept)), "kept")
    final = written(items.apply_amendments(items.merge(kept)), "final")
    return Analysis(final, rejected, facts.key_facts(final), facts.stats(final.unionByName(rejected)))


def report(analysis: Analysis, packages: DataFrame, manifest: DataFrame, created: str = "", model: str = "") -> DataFrame:
    """All lines of all packages' Markdown reports, the removed items last."""
    titled = lambda df: reports.with_titles(df, packages, manifest)
    return reports.markdown(titled(analysis.items), titled(analysis.facts), reports.headed(packages, manifest), analysis.rejected, created, model)


def cleaned(analysis: Analysis, pages: DataFrame) -> Analysis:
    """The analysis with contact details gone from statements and quotes; names are those that the packages' pages give.
    Meant for what is written out: scores are taken before."""
    names = written(redaction.names_of(pages.select("package_id", searchable(F.col("text"), F.col("reading")).alias("text")), "text"), "names")

    def clean(df: DataFrame) -> DataFrame:
        for column in ("statement", "quote"):
            df = redaction.redact(df, column, names=names)
        return df

    return Analysis(clean(analysis.items), clean(analysis.rejected), clean(analysis.facts), analysis.stats)
