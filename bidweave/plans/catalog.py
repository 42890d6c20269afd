"""Queries over the operators on the test tables, with SQL twins where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidweave.functions import constants as K
from bidweave.functions import dates as D
from bidweave.functions import text as T
from bidweave.operators import facts, items, keyword, pages, quotes, redaction, replies, reports, scoring
from bidweave.plans import pipeline
from bidweave.plans.sql import SQL  # noqa: F401
from bidweave.session import written
from bidweave.sources.tables import records, table

FLAGSHIP = "quote_exact"
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _int(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


# sources and pages


@query
def page_records(spark: SparkSession, d: str) -> DataFrame:
    """Pages without redeliveries, by package and role."""
    p = records(spark, d, "pages")
    return p.groupBy("package_id", "role").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))


@query
def package_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document of every package with its role, manifest entries attached."""
    p, m = table(spark, d, "packages"), table(spark, d, "manifest_documents")
    branch = lambda ids, role: p.select("package_id", F.explode(ids).alias("id"), F.lit(role).alias("role"))
    listed = branch(F.array("base"), "base").unionByName(branch("amendments", "amendment")).unionByName(branch("attachments", "attachment")).where("id IS NOT NULL")
    late = m.where("attachment_of IS NOT NULL").select(F.col("attachment_of").alias("base"), "id").join(p.select("base", "package_id"), "base").select("package_id", "id", F.lit("attachment").alias("role"))
    every = listed.unionByName(late.join(listed.select("package_id", "id"), ["package_id", "id"], "left_anti"))
    return every.join(m.select("id", "title", "short"), "id", "left").select("package_id", "id", "role", F.coalesce(F.nullif("short", F.lit("")), "title").alias("label"))


@query
def packages_without_items(spark: SparkSession, d: str) -> DataFrame:
    p, i = table(spark, d, "packages"), table(spark, d, "items")
    there = p.join(i, "package_id", "left_semi").select("package_id", F.lit(True).alias("has_items"))
    return there.unionByName(p.join(i, "package_id", "left_anti").select("package_id", F.lit(False).alias("has_items")))


@query
def page_split(spark: SparkSession, d: str) -> DataFrame:
    """Documents' texts with form feeds split into pages again."""
    p = records(spark, d, "pages")
    # one document's pages; a document is a file
    joined = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("l")).select("doc_id", F.concat(F.array_join(F.transform("l.text", lambda t: F.coalesce(t, F.lit(""))), "\f"), F.lit("\f")).alias("text"))
    return pages.split_pages(joined).select("doc_id", "page", F.md5("text").alias("text_md5"))


@query
def rendering_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = records(spark, d, "pages")
    reading = p.where(T.empty(F.col("reading")) != "").select("doc_id", "page", F.col("reading").alias("text"))
    both = pages.pair_renderings(p.select("doc_id", "page", "text"), reading)
    return both.select("doc_id", "page", F.length("reading").alias("reading_chars"), F.length(pages.searchable(F.col("text"), F.col("reading"))).alias("searchable_chars"))


@query
def blank_pages(spark: SparkSession, d: str) -> DataFrame:
    b = pages.blank_pages(records(spark, d, "pages"))
    return b.select("doc_id", F.array_join(F.transform("blank", lambda x: x.cast("string")), ",").alias("blank"))


@query
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    c = pages.pack_pages(records(spark, d, "pages"))
    return c.select("doc_id", "chunk_idx", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


@query
def chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    """Packed chunks with page markers, against the chunks that were stored."""
    c = pages.chunk_texts(records(spark, d, "pages"))
    stored = table(spark, d, "chunks").select(F.xxhash64("text").alias("h")).distinct()
    return c.withColumn("h", F.xxhash64("text")).join(stored.withColumn("stored", F.lit(True)), "h", "left").select(
        "doc_id", "chunk_idx", F.length("text").alias("chars"), F.coalesce("stored", F.lit(False)).alias("stored"))


@query
def footer_trim(spark: SparkSession, d: str) -> DataFrame:
    p = records(spark, d, "pages")
    return p.select("page_id", F.length(T.strip_footer(F.col("text"))).alias("chars"), F.md5(T.strip_footer(F.col("text"))).alias("text_md5"))


@query
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    p = records(spark, d, "pages")
    return p.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


@query
def package_roles(spark: SparkSession, d: str) -> DataFrame:
    """Whether a package's pages come from exactly one base document."""
    p = table(spark, d, "pages")
    n = lambda r: F.count_distinct(F.when(F.col("role") == r, F.col("doc_id")))
    return p.groupBy("package_id").agg(n("base").alias("bases"), n("amendment").alias("amendments"), n("attachment").alias("attachments")).withColumn("valid", F.col("bases") == 1)


# text columns


@query
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select(F.explode(T.words(F.col("text"))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n"))


@query
def squash_text(spark: SparkSession, d: str) -> DataFrame:
    i = records(spark, d, "items")
    return i.select("seq", F.md5(T.squash(F.col("quote"))).alias("squashed_md5"), F.size(T.words(F.col("quote"))).cast("bigint").alias("words"))


@query
def nfkc_squash(spark: SparkSession, d: str) -> DataFrame:
    """Squashed quotes after NFKC; only texts that aren't ASCII leave the JVM."""
    i = T.with_nfkc(records(spark, d, "items").select("seq", "quote"), "quote")
    return i.select("seq", F.md5(T.squash(F.col("quote"))).alias("squashed_md5"))


@query
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = keyword.page_sentences(records(spark, d, "pages"))
    return s.groupBy("document", "page").agg(F.count("*").alias("sentences"), F.sum(F.length("text")).alias("chars"))


@query
def html_escaped(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest_documents")
    i = records(spark, d, "items").select(F.col("seq").cast("string").alias("id"), F.col("statement").alias("text"))
    both = m.select("id", F.col("title").alias("text")).unionByName(i)
    return both.select("id", T.html_escape(T.empty(F.col("text"))).alias("escaped"))


@query
def file_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest_documents").select("id", T.file_name(F.col("title")).alias("name"))


@query
def keyword_flags(spark: SparkSession, d: str) -> DataFrame:
    s = keyword.flagged(records(spark, d, "pages"))
    return s.groupBy("document").agg(*[F.count_if(k).alias(k) for k in K.KEYWORDS])


# dates


@query
def find_dates(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, "items").select("seq", F.array_join(D.find_dates(F.col("quote")), ",").alias("dates"))


@query
def find_times(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d, "items").select("seq", F.array_join(D.find_times(F.col("quote")), ",").alias("times"))


@query
def display_dates(spark: SparkSession, d: str) -> DataFrame:
    i = records(spark, d, "items")
    return i.select("seq", D.long_form(F.col("date"), F.col("time"), F.lit("Not found")).alias("long"), D.short_form(F.col("date")).alias("short"))


@query
def check_dates(spark: SparkSession, d: str) -> DataFrame:
    """Warnings about dates and times, on items as extracted."""
    i = records(spark, d, "items").withColumn("warnings", F.array().cast("array<string>"))
    return items.check_dates(i).select("seq", "date", F.array_join("warnings", " ").alias("warnings"))


# quotes


def _quotes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    i, p = records(spark, d, "items"), records(spark, d, "pages")
    i = T.with_nfkc(i.select("seq", "document", "page", "quote"), "quote")
    q = i.select("seq", F.col("document").alias("doc_id"), F.col("page").alias("cited"), T.squash(F.col("quote")).alias("key")).where(F.length("key") >= K.LEAST_KEY)
    # both are read by each tier
    return written(q, "keys"), written(quotes.features(p).drop("body"), "squashed")


@query
def quote_exact(spark: SparkSession, d: str) -> DataFrame:
    """The first page that holds each quote letter for letter, the cited page before others."""
    q, p = _quotes(spark, d)
    return quotes.exact(q, p).select("seq", F.col("found_page").alias("page"))


@query
def quote_status(spark: SparkSession, d: str) -> DataFrame:
    """Exact, moved and open quotes by model."""
    q, p = _quotes(spark, d)
    found = quotes.exact(q, p)
    i = records(spark, d, "items").select("seq", "model", F.col("page").alias("cited"))
    state = F.when(F.col("found_page").isNull(), "open").when(F.col("found_page").eqNullSafe(F.col("cited")), "exact").otherwise("moved")
    return i.join(found, "seq", "left").groupBy("model", state.alias("status")).agg(F.count("*").alias("items"))


@query
def cross_page(spark: SparkSession, d: str) -> DataFrame:
    """Texts that run over a page break (the end of each page, its footer gone, and the beginning of the next), sought like
    quotes: those that no single page holds are found on the pair of pages."""
    p = records(spark, d, "pages")
    feats = quotes.features(p)
    own = Window.partitionBy("doc_id").orderBy("page")
    ends = feats.select("doc_id", "page", T.squash(T.strip_footer(F.col("body"))).alias("end"), F.lead("page").over(own).alias("then"), F.lead("sq").over(own).alias("begin"))
    q = ends.where(F.col("then") == F.col("page") + 1).select(F.concat_ws("#", "doc_id", F.col("page").cast("string")).alias("seq"), "doc_id", F.col("page").alias("cited"), F.concat(F.expr("right(end, 20)"), F.expr("left(begin, 20)")).alias("key"))
    q = written(q.where(F.length("key") >= K.LEAST_KEY), "breaks")
    left = q.join(quotes.exact(q, feats), "seq", "left_anti")
    hits = left.join(quotes.spans(feats), "doc_id").where(F.contains(F.col("sq"), F.col("key")))
    return hits.groupBy(F.col("seq").alias("place")).agg(F.min("page").alias("page"))


@query
def quote_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Share of each quote's words that its cited page has."""
    i, p = records(spark, d, "items"), records(spark, d, "pages")
    q = i.select("seq", F.col("document").alias("doc_id"), "page", F.array_distinct(T.words(F.col("quote"))).alias("qw")).where(F.size("qw") > 0)
    both = q.join(p.select("doc_id", "page", T.words(F.col("text")).alias("pw")), ["doc_id", "page"])
    return both.select("seq", F.bround(F.size(F.array_intersect("qw", "pw")) / F.size("qw"), 6).alias("overlap"))


@query
def quote_locate(spark: SparkSession, d: str) -> DataFrame:
    """All tiers: exact, across a break, near, put together from cells."""
    return quotes.locate(records(spark, d, "items"), records(spark, d, "pages"))


@query
def verify_items(spark: SparkSession, d: str) -> DataFrame:
    """Kept and rejected items by package, with the warnings that verification adds."""
    i = records(spark, d, "items").withColumn("cited_page", F.col("page")).withColumn("warnings", F.array().cast("array<string>"))
    kept, gone = items.verify(i, quotes.locate(i, records(spark, d, "pages")))
    both = kept.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False)))
    return both.groupBy("package_id", "kept").agg(F.count("*").alias("items"), F.count_if(F.size("warnings") > 0).alias("warned"))


# items


@query
def coerce_replies(spark: SparkSession, d: str) -> DataFrame:
    """Items written as model replies, fenced or in prose, and read back."""
    i = records(spark, d, "items")
    one = F.to_json(F.struct(F.array(F.struct("kind", "statement", "quote", F.col("page").cast("string").alias("page"), "date", "time", "weight")).alias("items")))
    reply = F.when(F.pmod("seq", F.lit(3)) == 0, F.concat(F.lit("```json\n"), one, F.lit("\n```"))).when(F.pmod("seq", F.lit(3)) == 1, F.concat(F.lit("Here it is: "), one, F.lit(" Done."))).otherwise(one)
    out = items.coerce(i.select("seq", reply.alias("reply")))
    return out.select("seq", "kind", F.md5("statement").alias("statement_md5"), F.md5("quote").alias("quote_md5"), F.col("page").cast("bigint").alias("page"))


@query
def reclassified(spark: SparkSession, d: str) -> DataFrame:
    return items.reclassify(records(spark, d, "items")).select("seq", "kind")


@query
def amendments(spark: SparkSession, d: str) -> DataFrame:
    i = records(spark, d, "items").withColumn("superseded_by", F.lit(None).cast("string"))
    return items.apply_amendments(i).where("superseded_by IS NOT NULL").select("seq", "superseded_by")


@query
def merged_items(spark: SparkSession, d: str) -> DataFrame:
    """Items left once repeats are folded into their first."""
    m = items.merge(records(spark, d, "items"))
    return m.select("seq", "kind", F.array_join(F.transform(F.array_sort("also_on"), lambda x: x.cast("string")), ",").alias("also_on"))


@query
def equal_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Repeats word for word: the first of each and the other pages of its document that have it."""
    i = records(spark, d, "items").withColumn("q", T.squash(F.col("quote"))).where("q <> ''")
    g = i.groupBy("package_id", "kind", "document", "q").agg(F.min("seq").alias("seq"), F.count("*").alias("items"), F.array_sort(F.collect_set("page")).alias("pages"))
    return g.where("items > 1").select("seq", "items", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


@query
def key_facts(spark: SparkSession, d: str) -> DataFrame:
    return facts.key_facts(records(spark, d, "items")).select("package_id", "fact", "seq", "date", "page")


@query
def report_stats(spark: SparkSession, d: str) -> DataFrame:
    return facts.stats(records(spark, d, "items"))


@query
def category_sections(spark: SparkSession, d: str) -> DataFrame:
    return _int(reports.sections(records(spark, d, "items")), "section", "items")


@query
def stats_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Verified items by model and package, with totals by model and over all."""
    i = records(spark, d, "items")
    ok = items.verified(F.col("verification"))
    g = i.rollup("model", "package_id").agg(F.count_if(ok).alias("verified"), F.count("*").alias("items"))
    return g.withColumn("share", T.percent(F.col("verified"), F.col("items")))


@query
def analyzed(spark: SparkSession, d: str) -> DataFrame:
    """The whole analysis of the extracted items: counts of each package."""
    return pipeline.analyze(records(spark, d, "items"), records(spark, d, "pages")).stats


# baseline and scoring


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    """Pages with the place of their document in its package: base, amendments, attachments as listed."""
    p = table(spark, d, "packages")
    given = p.select("package_id", F.posexplode(F.concat(F.array("base"), F.coalesce("amendments", F.array().cast("array<string>")), F.coalesce("attachments", F.array().cast("array<string>")))).alias("doc_order", "doc_id"))
    first = given.where("doc_id IS NOT NULL").groupBy("package_id", "doc_id").agg(F.min("doc_order").alias("doc_order"))
    return records(spark, d, "pages").join(first, ["package_id", "doc_id"], "left")


@query
def keyword_baseline(spark: SparkSession, d: str) -> DataFrame:
    b = keyword.baseline(_ordered(spark, d))
    return b.select("package_id", "kind", "document", "page", "role", "date", "time", "weight", F.md5("statement").alias("statement_md5"))


def _two_models(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The facts of the model with most items as reference, those of all others as found."""
    i = records(spark, d, "items")
    lead = i.groupBy("model").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model").limit(1).select("model")
    return i.join(lead, "model", "left_semi"), i.join(lead, "model", "left_anti")


@query
def score_facts(spark: SparkSession, d: str) -> DataFrame:
    """The other models' deadlines against those of the model with most items."""
    ref, other = _two_models(spark, d)
    pick = lambda x: facts.dated(items.live(x), "response_due").unionByName(facts.dated(items.live(x), "questions_due"))
    gold = pick(ref).select("package_id", "fact", F.lit(True).alias("stated"), "date", "time", F.array(F.lower("statement")).alias("any"))
    return scoring.score_facts(gold, pick(other)).select("package_id", "fact", "correct", "time_correct", "expected")


@query
def score_totals(spark: SparkSession, d: str) -> DataFrame:
    ref, other = _two_models(spark, d)
    pick = lambda x: facts.dated(items.live(x), "response_due").unionByName(facts.dated(items.live(x), "questions_due"))
    gold = pick(ref).select("package_id", "fact", F.lit(True).alias("stated"), "date", "time", F.array(F.lower("statement")).alias("any"))
    t = scoring.totals(scoring.score_facts(gold, pick(other)))
    return t.withColumn("share", T.percent(F.col("facts_correct"), F.col("facts_total")))


@query
def score_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What a table of results says of each scored deadline."""
    ref, other = _two_models(spark, d)
    pick = lambda x: facts.dated(items.live(x), "response_due").unionByName(facts.dated(items.live(x), "questions_due"))
    gold = pick(ref).select("package_id", "fact", F.lit(True).alias("stated"), "date", "time", F.array(F.lower("statement")).alias("any"))
    return scoring.verdict(scoring.score_facts(gold, pick(other))).groupBy("fact", "verdict").agg(F.count("*").alias("n"))


def _checklist(ref: DataFrame) -> DataFrame:
    """Lines of a reference: an item is covered by its longest word and one of the two next."""
    long = F.slice(F.array_sort(F.transform(F.array_distinct(T.words(F.col("statement"))), lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), 1, 3)
    gold = ref.select("package_id", F.col("seq").alias("id"), F.col("statement").alias("text"), long.alias("l")).where(F.size("l") == 3)
    return gold.select("package_id", "id", "text", F.array(F.array(F.col("l")[0]["w"]), F.array(F.col("l")[1]["w"], F.col("l")[2]["w"])).alias("all"))


def _factors(ref: DataFrame) -> DataFrame:
    return ref.where("kind = 'evaluation_factor'").select(
        "package_id", F.col("seq").alias("id"), F.array(F.try_element_at(T.words(F.col("statement")), F.lit(1))).alias("names"), F.when(T.empty(F.col("weight")) != "", F.lower("weight")).alias("weight"))


@query
def missed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the reference that the other models miss."""
    ref, other = _two_models(spark, d)
    lines = _checklist(ref)
    return scoring.missed(scoring.score_checklist(lines, other), lines).select("package_id", "id", F.md5("text").alias("text_md5"))


@query
def evaluation_results(spark: SparkSession, d: str) -> DataFrame:
    """All counts of the other models against the reference, by package and over all."""
    ref, other = _two_models(spark, d)
    pick = lambda x: facts.dated(items.live(x), "response_due").unionByName(facts.dated(items.live(x), "questions_due"))
    gold = pick(ref).select("package_id", "fact", F.lit(True).alias("stated"), "date", "time", F.array(F.lower("statement")).alias("any"))
    factors = scoring.score_factors(_factors(ref), other.where("kind = 'evaluation_factor'"))
    return scoring.results(scoring.score_facts(gold, pick(other)), factors, scoring.score_checklist(_checklist(ref), other), other)


@query
def evaluation_table(spark: SparkSession, d: str) -> DataFrame:
    """Tables of results: the other models and the keyword baseline against the reference."""
    ref, other = _two_models(spark, d)
    pick = lambda x: facts.dated(items.live(x), "response_due").unionByName(facts.dated(items.live(x), "questions_due"))
    gold = pick(ref).select("package_id", "fact", F.lit(True).alias("stated"), "date", "time", F.array(F.lower("statement")).alias("any"))
    factors, lines = _factors(ref), _checklist(ref)
    b = written(keyword.baseline(_ordered(spark, d)).withColumn("superseded_by", F.lit(None).cast("string")), "baseline")

    def of(found: DataFrame, own: DataFrame) -> DataFrame:
        scored = scoring.score_factors(factors, own.where("kind = 'evaluation_factor'"))
        return scoring.results(scoring.score_facts(gold, found), scored, scoring.score_checklist(lines, own), own)

    return scoring.table(of(pick(other), other), of(b.where("kind IN ('response_due', 'questions_due')").withColumn("fact", F.col("kind")), b))


@query
def score_checklist(spark: SparkSession, d: str) -> DataFrame:
    """Whether the other models cover the lines of the reference, by two of a line's longest words."""
    ref, other = _two_models(spark, d)
    return scoring.score_checklist(_checklist(ref), other)


@query
def score_factors(spark: SparkSession, d: str) -> DataFrame:
    ref, other = _two_models(spark, d)
    return scoring.score_factors(_factors(ref), other.where("kind = 'evaluation_factor'"))


# redaction


@query
def redact_contacts(spark: SparkSession, d: str) -> DataFrame:
    i = records(spark, d, "items")
    r = redaction.redact_addresses(F.col("quote"))
    return i.select("seq", r.alias("redacted")).where(r != F.col("quote"))


@query
def contact_names(spark: SparkSession, d: str) -> DataFrame:
    i = records(spark, d, "items")
    return i.select("package_id", F.explode(redaction.contact_names(F.col("quote"))).alias("name")).groupBy("package_id", "name").agg(F.count("*").alias("n"))


@query
def redact_names(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain, names of a package removed from all its quotes."""
    i = records(spark, d, "items").select("package_id", "seq", "quote")
    return redaction.redact(i, "quote").select("seq", F.md5("quote").alias("redacted_md5"), F.contains(F.col("quote"), F.lit("[name]")).alias("has_name"))


# reports, replies


def _titled(spark: SparkSession, d: str) -> DataFrame:
    return reports.with_titles(records(spark, d, "items"), table(spark, d, "packages"), table(spark, d, "manifest_documents"))


@query
def cite_labels(spark: SparkSession, d: str) -> DataFrame:
    return _titled(spark, d).select("seq", reports.cite().alias("label"))


@query
def markdown_items(spark: SparkSession, d: str) -> DataFrame:
    return _int(reports.item_lines(_titled(spark, d)), "section", "nth")


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Kept items, key facts and rejected items with titles, and packages with theirs."""
    i = _titled(spark, d)
    p, m = table(spark, d, "packages"), table(spark, d, "manifest_documents")
    return i.where("NOT verification <=> 'missing'"), reports.with_titles(facts.key_facts(records(spark, d, "items")), p, m), i.where("verification <=> 'missing'"), reports.headed(p, m)


@query
def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    """All lines of all packages' reports."""
    i, f, gone, p = _parts(spark, d)
    return _int(reports.markdown(i, f, p, gone, "2026-01-01", "all models"), "part", "section", "nth")


@query
def html_report(spark: SparkSession, d: str) -> DataFrame:
    """All lines of all packages' HTML pages."""
    i, f, gone, p = _parts(spark, d)
    return reports.html_page(i, f, p, facts.stats(records(spark, d, "items")), gone, "all models")


@query
def json_report(spark: SparkSession, d: str) -> DataFrame:
    """All packages' JSON reports, as lines."""
    i, f, gone, p = _parts(spark, d)
    pages_ = records(spark, d, "pages").groupBy("package_id", F.col("doc_id").alias("id"), "role").agg(F.count("*").alias("pages"))
    m = table(spark, d, "manifest_documents").select("id", "title", F.coalesce(F.nullif("short", F.lit("")), "title").alias("short"))
    answers, _ = _asked(spark, d)
    of = table(spark, d, "chunks").select("doc_id", "package_id").distinct()
    return reports.json_report(i, gone, f, p, pages_.join(m, "id", "left"), facts.stats(records(spark, d, "items")), replies.errors(answers).join(of, "doc_id").select("package_id", "error"), {"created": "2026-01-01", "model": "all models", "provider": "tables", "seconds": 0.0})


@query
def html_items(spark: SparkSession, d: str) -> DataFrame:
    return reports.html(_titled(spark, d))


@query
def json_items(spark: SparkSession, d: str) -> DataFrame:
    return reports.json_rows(records(spark, d, "items"))


class Lengths:
    """A provider on this machine: it answers with the length of what it was asked, four characters of which take one token
    of the budget."""

    name, model = "local", "lengths"

    def complete(self, system: str, user: str, schema: str, budget: int) -> str:
        if len(user) > 4 * budget:
            raise replies.TooLong(str(budget))
        return f'{{"items": [], "chars": {len(user)}}}'


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "chunks").select("doc_id", F.col("chunk_id").cast("int").alias("chunk_idx"), "pages", "text")
    return replies.ask(c, Lengths(), budget=1200)


@query
def cached_requests(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk asked of a provider on this machine, page by page where its reply is too long."""
    answers, _ = _asked(spark, d)
    out = answers.groupBy(F.col("chunk_idx").cast("bigint").alias("chunk_id")).agg(
        F.count("*").alias("requests"), F.count_if(F.col("error") == replies.TOO_LONG).alias("too_long"), F.count_if(F.col("error").startswith("page")).alias("lost"), F.sum(F.get_json_object("reply", "$.chars").cast("bigint")).alias("chars"))
    return out


@query
def request_counters(spark: SparkSession, d: str) -> DataFrame:
    """Hits and misses of the same requests asked again with what was kept."""
    c = table(spark, d, "chunks").select("doc_id", F.col("chunk_id").cast("int").alias("chunk_idx"), "pages", "text")
    _, entries = replies.ask(c, Lengths(), budget=1200)
    answers, _ = replies.ask(c, Lengths(), written(entries, "kept"), budget=1200)
    return replies.counters(answers)


@query
def landed_items(spark: SparkSession, d: str) -> DataFrame:
    """A stream of all deliveries, drained: items by week of extraction and model."""
    from bidweave.streaming import landing

    w = landing.drain(landing.windowed(landing.read_stream(spark, d, "items")))
    return w.select(F.date_format("w.start", "yyyy-MM-dd").alias("week"), "model", "items", "missing")
