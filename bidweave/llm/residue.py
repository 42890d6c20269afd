"""Template residue, filler and error pages in a corpus.

Each text is looked at sentence by sentence, and each sentence is compared with the terms of the document's address slug
(the package id) and title.

* Detectors that hold by themselves find unfilled fields of templates (``placeholder``), filler words and phrases
  (``filler``), notices about scripts, cookies or browsers (``notice``) and error or outage messages (``error``), in
  English, Spanish, French and German. A sentence that says what somebody shall or will do about such things is part
  of the work and is no finding.
* The others are sentences that don't mention the subject: they share no term with slug or title (terms that every
  hundredth title has, as "statement", aren't a subject). One that stands word for word, digits and codes aside, under
  several titles tells nothing of any of them: it is a *duplicated low-information response*. Titles, not documents, are
  counted, so that copies of a document are one; a single host needs twice as many titles as several hosts together.
* A document of which nothing but such responses (and its title) is left is residue whatever its language
  (``response``). So is one with a response that by the combined evidence of all hosts comes with residue: of the titles
  it stands under, the share with other residue is surely (lower bound of the share) above ``SHARE`` (``company``). Each
  document found is evidence for the next, until no document is added.

So furniture of broken sites ("go back to the index") is learnt from the messages next to it, and messages that no
detector knows are learnt from the furniture; a line that stands on sound pages as well never counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.llm.sieve import Sieve
from bidweave.session import written

_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[ _.\-][A-Za-z0-9]+){0,4}"
#: Unfilled fields in the notations of common template languages and forms. They hold in any language and keep to case.
PLACEHOLDER = [
    r"\{\{\s*[^{}\n]{0,60}\}\}", r"[$#]\{\s*[^{}\n]{1,60}\}", r"\{\d{1,2}\}", r"<%=?\s*[^%\n]{1,60}%>", r"%\(" + _NAME + r"\)[sd]", r"%%" + _NAME + "%%",
    "@@" + _NAME + "@@", r"__[A-Za-z]+(?:_[A-Za-z]+)*__", r"\[\[" + _NAME + r"\]\]", "<<" + _NAME + ">>", "«" + r"[A-Za-z]+(?:[_.][A-Za-z]+)*" + "»",
    r"\[\s*(?i:insert|enter|your|type|add|choose|select|placeholder|xxx+|tbd|tbc|todo)\b[^\]\n]{0,60}\]", r"\[[^\]\n]{1,60}\b(?:TBD|TBC|TODO|HERE)\s*\]",
    r"<(?:[A-Z]{3,}|[A-Z]{2,}(?:[ _.\-][A-Z]{2,})+)>", r"\bXX/XX/(?:20)?XX(?:XX)?\b", r"\$X{1,3}(?:,XXX)+(?:\.XX)?", r"(?i:\bclick (?:or tap )?here to enter\b)",
]
# The words of the customary filler text.
_LOREM = "lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|eiusmod|tempor|incididunt|labore|magna|aliqua|enim|minim|veniam|quis|nostrud|nulla|velit|vitae|porta|risus|felis|justo|massa|augue|arcu|orci|nunc|morbi|tellus"
FILLER = [
    rf"\b(?:{_LOREM})(?:\W+(?:{_LOREM})\b){{3,}}",
    r"\btest entry \d*,? ?please ignore", r"\btesting(?:\W+\d)+\W+testing\b", r"\bthis is (?:only |just )?a test\b", r"\b(?:put|insert|add|write|place|type|enter) (?:the|your|a) [\w ]{0,40}\b(?:in this space|goes here|text here|here\b)",
    r"\b(?:text|description|content|summary) (?:goes|to go|to come) here\b", r"\b(?:sample|dummy|placeholder|filler) (?:text|copy|content)\b[^.]{0,20}(?:here|ignore|$)", r"\basdf(?:gh)?\b|\bqwerty\b|\bfoo bar\b|\bblah blah\b",
    r"^\W*(?:to ?do|tbd|fixme)\s*[:\-–]\s*\w+(?:\W+\w+){0,4}\W*$", r"\b(?:dummy|sample|example|placeholder|filler|mock)\b[\w ]{0,40}\b(?:layout purposes|only\W+(?:please )?(?:overwrite|replace|delete)|to be replaced|to be overwritten|placeholder)\b",
    r"\b(?:text|copy|content|paragraph|title|heading|headline|image|caption) placeholder\b", r"\bcontent for layout\b|\bfor layout purposes\b", r"\bto be replaced by the (?:author|editor|writer)\b|\bonly\W{1,4}overwrite\b|\boverwrite this\b|\breplace this (?:text|paragraph|sentence|section|with)\b",
    r"\b(?:write|put|add|enter) (?:a|one|two|three|some|your)\b[\w ]{0,40}\b(?:sentences?|paragraphs?|words|lines)\b[\w ]{0,40}\b(?:here|in place of this|instead of this|below this)\b", r"\byour [\w ]{0,30}\b(?:text|paragraph|content|title|heading|name|logo|copy)\b[\w ]{0,12}\b(?:goes )?here\b",
    r"\b(?:paragraph|heading|title|copy|image|table|chart) goes here\b", r"^\W*(?:sub)?heading(?: (?:one|two|three|\d))?\W*$", r"\bthis (?:section|page|text|paragraph) (?:is )?intentionally left (?:as )?(?:filler|placeholder)\b",
    r"\bcoming soon\b\W*$", r"\bto be (?:written|supplied|filled in) later\b",
]
_SCRIPT = r"(?:java ?script|scripts?|scripting|active content|cookies)"
_THING = r"(?:page|site|website|portal|service|listing|tender|bid|notice|document|record|file|attachment|solicitation|amendment|folder|view|application|app|request|resource|content|link|url|item|board|viewer)"
#: Messages by language and kind.
MESSAGES = {
    "en": {
        "notice": [
    rf"\b(?:enable|enabling|activate|switch on|turn on|allow|permit|accept|needs?|requires?|without|only works with)\b.{{0,30}}\b{_SCRIPT}\b",
    rf"\b{_SCRIPT}\b.{{0,30}}\b(?:is|are|appears?(?: to be)?|must be|needs? to be|seems?)\b.{{0,20}}\b(?:blocked|disabled|off|required|enabled|needed|turned off|switched off)\b",
    r"\b(?:update|upgrade|change) (?:the|your) browser\b", r"\byour browser\b.{0,40}\b(?:out of date|outdated|old|not supported|unsupported|cannot|can't|does not|doesn't)\b", r"\bbrowser (?:is )?(?:not|no longer) supported\b",
    r"\bturn (?:off|on)\b.{0,30}\b(?:ad ?blocker|in your browser)\b", r"\bdisable\b.{0,20}\bad ?blocker\b", r"\bcomplete the captcha\b|\bnot a robot\b|\bverif(?:y|ying) (?:that )?you are (?:a )?human\b|\bchecking your browser\b", "<noscript", r"\bwill not load without them\b",
        ],
        "error": [
    rf"\b(?:the|this|that|requested)\b.{{0,30}}\b{_THING}\b.{{0,12}}\b(?:has expired|failed to (?:load|open)|timed out|was blocked|returned an empty response|(?:is|was) no longer (?:hosted|available|here|online)|(?:could|can) ?not be (?:opened|located|found|displayed|shown|reached|loaded|retrieved)|can't be (?:found|shown|displayed|reached|opened)|(?:is|was) (?:currently |temporarily )?(?:not available|not found|unavailable|offline|down)|has (?:been )?(?:moved|removed|deleted)|is gone|was deleted|does(?: not|n't) exist|is down for)\b",
    r"\bpage (?:was )?not found\b", r"\bhttp(?: error)? [45][0-9][0-9]\b", r"^\W*(?:error|status|code)\W*[45][0-9][0-9]\W*(?:$|:|[-–—])", r"^\W*[45][0-9][0-9]\W*(?::|[-–—]) *[^\W\d]", r"\berror (?:code )?[45][0-9][0-9]\b", r"\bfatal error\b|\bunhandled exception\b|\bstack ?trace\b|\bnull reference\b|\bnullpointer|\btraceback \(|\b\w+(?:error|exception)\b at \w|\bsegmentation fault\b|\btimeout after \d",
    r"\bgateway\b.{0,20}\b(?:no valid answer|timed? ?out|timeout|error)\b", r"\bupstream server\b", r"\b(?:your )?session (?:has )?(?:timed out|expired|ended)\b", r"\btoo many requests\b|\bslow down and try\b|\brate limit exceeded\b", r"\b(?:hit a snag|something went wrong)\b",
    r"\bcould ?n[o']t find (?:that|this|the) " + _THING, r"\bdown for (?:scheduled|planned|routine)?\s*(?:upkeep|maintenance)\b|\bunder maintenance\b", r"\binternal server error\b|\bbad gateway\b|\bservice unavailable\b|\bforbidden\b\W*$|^\W*access denied\W*$|\byou (?:do not|don't) have (?:permission|access)\b",
    r"\btry again (?:later|in a (?:few|moment))\b|\bplease come back later\b|\blog in again to see\b", r"^\W*(?:oops|whoops|uh[- ]oh)\b",
            r"\baccess (?:to (?:this|the|that) \w+ )?(?:is |was |has been )?(?:denied|refused|restricted)\W*(?:$|\()",
        ],
    },
    "es": {
        "notice": [
    r"\b(?:active|activar|habilite|habilitar|acepte|aceptar|permita|permitir)\b.{0,20}\b(?:javascript|cookies|scripts?)\b", r"\bnavegador\b.{0,40}\b(?:no (?:es|está|admite|soporta)|obsoleto|compatible|desactualizado)\b",
        ],
        "error": [
    r"\bp[aá]gina\b.{0,30}\b(?:no existe|no encontrada|no (?:está )?disponible)|\bno se (?:ha )?(?:encontr|pudo)\w*.{0,20}\bp[aá]gina\b|\b(?:servicio|sitio|portal)\b.{0,30}\b(?:no (?:está )?disponible|fuera de servicio|en mantenimiento)|\bsu sesión (?:ha )?(?:caducado|expirado|caducó|expiró)|\bint[eé]ntelo (?:de nuevo )?más tarde|\bvuelva a intentarlo",
            r"\bacceso (?:denegado|prohibido|restringido)",
        ],
    },
    "fr": {
        "notice": [
    r"\b(?:activer|activez|accepter|acceptez|autoriser|autorisez)\b.{0,20}\b(?:javascript|cookies|scripts?)\b", r"\bnavigateur\b.{0,40}(?:pas pris en charge|obsol|n'est plus|incompatible)",
        ],
        "error": [
    r"\b(?:page|document|ressource|fichier)\b.{0,20}\bintrouvable|\berreur\s*[0-9][0-9][0-9]|\b(?:votre )?session (?:a )?expir|\b(?:service|site|page|portail)\b.{0,20}\bindisponible|\b(?:en|de) maintenance\b.{0,30}\bplus tard|\bréessayez plus tard|\berreur (?:interne|fatale)",
            r"\baccès (?:refusé|interdit|non autorisé)",
        ],
    },
    "de": {
        "notice": [
    r"\b(?:javascript|cookies|skripte?)\b.{0,30}\b(?:aktivier|akzeptier|einschalt|erlaub|zulass|anschalt)", r"\b(?:aktivieren|akzeptieren|erlauben) sie\b.{0,30}\b(?:javascript|cookies|skripte?)\b", r"\bbrowser\b.{0,20}(?:nicht unterst|veraltet)",
        ],
        "error": [
    r"\b(?:seite|dokument|datei)\b.{0,30}\bnicht (?:gefunden|verfügbar|vorhanden)|\bfehler\s*[0-9][0-9][0-9]|\bsitzung\b.{0,20}\babgelaufen|\b(?:dienst|seite|portal)\b.{0,30}\bnicht erreichbar|\bwartungsarbeiten|\bversuchen sie es (?:später )?(?:erneut|noch|später)|\binterner (?:server)?fehler",
            r"\bzugriff\b.{0,40}\b(?:verweigert|nicht erlaubt|gesperrt)|\bzugang verweigert",
        ],
    },
}
#: Sentences that speak of such things as part of the work.
WORK = "(?i)" + "|".join([
    r"\b(?:shall|contractor|vendors?|bidders?|offerors?|firms|crews)\b", r"\b(?:must|will) (?:be|answer|log|list|test|show|name|support|return|report|handle|include|stay)\b", r"\b(?:stay|remain)s? readable\b", r"\b(?:described|listed|named|defined) in the\b", r"\bpolicy\b(?! rule)", r"\btrigger a review\b",
    r"\bmessages? (?:of|is|are)\b", r"\bmerge fields\b|\bfields such as\b|\bcompleted by the\b|\bto be completed by\b", r"\bwas struck\b", r"\bin column <", r"\bmock-?ups?\b",
    r"\bdebe(?:rá|rán|n)\b.{0,60}\b(?:mostrar|probar|incluir|registrar)|\bdevra\b|\bmuss\b.{0,80}\b(?:anzeigen|prüfen|melden)\b",
])
#: Sentences that speak of fields as part of the work.
FIELDS = r"(?i)\b(?:merge fields|(?:fields|placeholders|tokens|variables|tags) (?:such as|like|named))\b|\bcompleted by the\b|\bto be completed by\b|\bin column <|\bwas struck\b"
LANGUAGES = tuple(MESSAGES)
#: A response stands under at least so many titles, twice as many at one host alone.
TITLES = 3
#: The lower bound (one-sided, 90 %) of the share of a response's titles that have other residue.
SHARE, Z = 0.6, 1.2816
#: A term that this share of all titles has is no subject.
COMMON = 0.01
_END = re.compile(r"([.!?;])\s+")
_OPEN, _GOES_ON = re.compile(r"[a-zà-ÿ0-9,]\s*$"), re.compile("[a-zà-ÿ]")
_DIGIT, _CODE = re.compile("[0-9]"), re.compile("[a-f]*[0-9][0-9a-f]*")
#: Signs and digits of ASCII as blanks.
_BLANKED = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))
_TERM = re.compile(r"[^\W\d_]{4,}")


@lru_cache(maxsize=4)
def _detectors(languages: tuple[str, ...] = LANGUAGES) -> tuple[Sieve, re.Pattern, re.Pattern]:
    rows = [("placeholder", p, 0) for p in PLACEHOLDER] + [("filler", p, re.I) for p in FILLER]
    rows += [(kind, p, re.I) for language in languages for kind, patterns in MESSAGES[language].items() for p in patterns]
    return Sieve(rows), re.compile(WORK), re.compile(FIELDS)


def sentences(text: str) -> list[str]:
    """Lines, cut further behind sentence ends; wrapped lines are put together first."""
    lines: list[str] = []
    for line in text.split("\n"):
        if lines and _GOES_ON.match(line) and _OPEN.search(lines[-1], max(0, len(lines[-1].rstrip()) - 1)):
            lines[-1] = lines[-1].rstrip() + " " + line
        else:
            lines.append(line)
    return [s for s in map(str.strip, _END.sub("\\1\n", "\n".join(lines)).split("\n")) if s]


def stutters(lowered: str) -> bool:
    """One word of at least four letters three times in a row, whatever signs stand between."""
    words = lowered.encode("utf-8", "surrogatepass").translate(_BLANKED).split()
    if not any(map(eq, words, words[1:])):
        return False
    return any(a == b and c.startswith(a) and len(a) > 3 for a, b, c in zip(words, words[1:], words[2:]))


def _verdict(sentence: str, found: set[str], work: re.Pattern, fields: re.Pattern) -> set[str]:
    """The findings that stand once a sentence about the work is let off."""
    if "placeholder" in found and fields.search(sentence):
        found.discard("placeholder")
    if found - {"placeholder"} and work.search(sentence):
        found &= {"placeholder"}
    return found


def reasons_of(sentence: str, languages: tuple[str, ...] = LANGUAGES) -> set[str]:
    """What one sentence is by itself."""
    sieve, work, fields = _detectors(languages)
    tried = sieve.tried([sentence.lower()])
    found = _verdict(sentence, sieve.names_of(sentence, tried.get(0, set())), work, fields)
    return found | ({"filler"} if stutters(sentence.lower()) else set())


def _code(text: str) -> int:
    """A signed 64-bit code."""
    code = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return code - (1 << 64) if code >> 63 else code


MARKED = "doc_id long, host long, title long, reasons array<string>, findings int, about int, forms array<long>"
_MARKED = pa.schema([("doc_id", pa.int64()), ("host", pa.int64()), ("title", pa.int64()), ("reasons", pa.list_(pa.string())), ("findings", pa.int32()), ("about", pa.int32()), ("forms", pa.list_(pa.int64()))])


def _mark(languages: tuple[str, ...], common: frozenset[str]):
    """Rows (doc_id, text, host, slug, title) -> findings of the detectors, the number of sentences about the subject, and
    the forms (digits and codes aside) of those that aren't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, work, fields = _detectors(languages)
        for batch in batches:
            out: list[list] = [[] for _ in _MARKED]
            for doc, text, host, slug, title in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "host", "slug", "title"))):
                parts = sentences(text)
                lowered = [s.lower() for s in parts]
                tried = sieve.tried(lowered)
                # where a title is missing, the first line stands for it
                name = title.strip().lower() or (lowered[0] if lowered else "")
                subject = [t for t in {*_TERM.findall(slug.lower()), *_TERM.findall(title.lower())} if t not in common]
                reasons, findings, about, forms = set(), 0, 0, set()
                for k, low in enumerate(lowered):
                    found = _verdict(parts[k], sieve.names_of(parts[k], tried[k]), work, fields) if k in tried else None
                    if found:
                        reasons |= found
                        findings += len(found)
                    elif low == name:
                        continue
                    elif any(t in low for t in subject):
                        about += 1
                    elif any(map(str.isalpha, low)):
                        forms.add(_code(_CODE.sub("#", low) if _DIGIT.search(low) else low))
                if stutters(" ".join(lowered)):
                    reasons.add("filler")
                    findings += 1
                for column, value in zip(out, (doc, _code(host), _code(name), sorted(reasons), findings, about, sorted(forms))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _MARKED)], schema=_MARKED)

    return run


def _common_terms(docs: DataFrame, share: float) -> frozenset[str]:
    """Terms that at least ``share`` of all titles have: at most the terms of a title, divided by ``share``."""
    n = docs.count()
    terms = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(r"\p{L}{4,}"), 0))).alias("term"))
    return frozenset(r["term"] for r in terms.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= max(share * n, 2)).collect())


def _surely(found: Column, of: Column) -> Column:
    """The lower bound of the share found / of (Wilson)."""
    p, z = found / of, F.lit(Z * Z)
    return (p + z / (2 * of) - Z * F.sqrt(p * (1 - p) / of + z / (4 * of * of))) / (1 + z / of)


def residue(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, titles: int = TITLES, share: float = SHARE) -> DataFrame:
    """(doc_id, reasons ARRAY<STRING>, residue INT) for each document with residue, ``residue`` being the number of
    the detectors' findings (1 where they have none). ``languages`` are those whose messages the detectors know.

    ``docs`` is (doc_id, text, source, title, package_id), ``doc_id`` unique. NULL text has no residue; NULL source,
    title and package_id are treated as empty; a NULL doc_id stays out; other columns are ignored; an empty table gives
    no rows. Whole texts are looked at, each once: all that follows reads a table of 64-bit codes.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    d = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", blank("source"), blank("package_id"), blank("title"))
    d = d.withColumnsRenamed({"source": "host", "package_id": "slug"})
    common = _common_terms(d.select("title"), COMMON)
    marked = written(d.mapInArrow(_mark(tuple(languages), common), MARKED), "marked")
    direct = marked.where("findings > 0").select("doc_id", "reasons", "findings")
    # only forms under several titles go on; a form that many documents have is one row a partition before the shuffle
    rows = marked.select("doc_id", "host", "title", F.explode("forms").alias("form"))
    under = rows.groupBy("form", "title").agg(F.min("host").alias("low"), F.max("host").alias("high")).groupBy("form").agg(
        F.count("*").alias("titles"), (F.min("low") != F.max("high")).alias("hosts"))
    known = written(under.where(F.col("titles") >= F.when(F.col("hosts"), titles).otherwise(2 * titles)).select("form"), "known")
    echoes = written(rows.join(known, "form", "left_semi"), "echoes")
    # nothing but its title and responses
    held = echoes.groupBy("doc_id").agg(F.count("*").alias("held"))
    bare = marked.where("about = 0 AND (findings > 0 OR size(forms) > 0)").select("doc_id", F.size("forms").alias("n")).join(held, "doc_id", "left")
    hollow = written(bare.where(F.coalesce("held", F.lit(0)) == F.col("n")).select("doc_id"), "hollow")
    found = written(direct.select("doc_id").union(hollow).distinct(), "found")
    while True:
        state = echoes.join(found.select("doc_id", F.lit(1).alias("other")), "doc_id", "left")
        per = state.groupBy("form", "title").agg(F.max(F.coalesce("other", F.lit(0))).alias("other")).groupBy("form").agg(F.sum("other").alias("found"), F.count("*").alias("of"))
        sure = per.where(_surely(F.col("found"), F.col("of")) >= share).select("form")
        beside = written(state.join(sure, "form", "left_semi").groupBy("doc_id").agg(F.max("other").alias("other")), "beside")
        more = beside.where("other IS NULL").select("doc_id")
        if more.isEmpty():
            break
        found = written(found.unionByName(more), "found")
    why = lambda df, reason: df.select("doc_id", F.array(F.lit(reason)).alias("reasons"), F.lit(0).alias("findings"))
    every = direct.unionByName(why(hollow, "response")).unionByName(why(beside, "company"))
    return every.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("reasons"))).alias("reasons"), F.greatest(F.sum("findings"), F.lit(1)).cast("int").alias("residue"))


def without_residue(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The corpus without the documents found; documents of NULL id stay."""
    return docs.join(found.select("doc_id"), "doc_id", "left_anti")
