"""SQL twins (DuckDB dialect) of the queries, over the same whole tables."""

from __future__ import annotations

import unicodedata

from bidweave.functions import constants as K

_PAGES = "p AS (SELECT * FROM pages WHERE page_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY loaded_at DESC NULLS LAST) = 1)"
_ITEMS = "i AS (SELECT * FROM items WHERE seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seq ORDER BY loaded_at DESC NULLS LAST) = 1)"
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({c}, ''), '^{_SPACE}+', ''), '{_SPACE}+$', '')"


def _squash(c: str) -> str:
    return f"regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', '', 'g')"


def _words(c: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda w: w <> '')"


def _has(c: str, pattern: str) -> str:
    return f"regexp_matches(coalesce({c}, ''), '(?i){pattern}')"


def _case(table: dict[str, str], c: str, otherwise: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {otherwise} END"


def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """What NFKC makes of signs that become letters or digits: one for one, and the joined ones; worked out from Unicode's
    own table."""
    one, to, many = "", "", []
    for code in [*range(0x80, 0x3000), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFFE0), *range(0x1D400, 0x1D800)]:
        form = unicodedata.normalize("NFKC", chr(code))
        if form != chr(code) and form.isascii() and any(map(str.isalnum, form)):
            if len(form) == 1:
                one, to = one + chr(code), to + form
            else:
                many.append((chr(code), form.replace("'", "''")))
    return one, to, many


_ONE, _TO, _MANY = _folds()


def _fold(c: str) -> str:
    """NFKC as far as letters and digits of ASCII are concerned: letters that take up an accent are none any more."""
    c = f"translate(coalesce({c}, ''), '{_ONE}', '{_TO}')"
    for a, b in _MANY:
        c = f"replace({c}, '{a}', '{b}')" if a in "ﬀﬁﬂﬃﬄﬅﬆ™℠…№½¼¾" else c
    return f"regexp_replace({c}, '[A-Za-z][\\x{{300}}-\\x{{36f}}]+', '', 'g')"


_CATEGORY = _case({k: f"'{c}'" for c, kinds in K.CATEGORIES.items() for k in kinds}, "kind", "'requirement'")
_SECTION = _case({c: str(n) for n, c in enumerate(K.CATEGORIES)}, "category", "NULL")
_FEATURES = f"""feats AS (SELECT doc_id, page, {_squash(_fold("CASE WHEN coalesce(reading, '') = '' THEN coalesce(text, '') ELSE coalesce(text, '') || chr(10) || 'zzrenderingbreakzz' || chr(10) || reading END"))} AS sq FROM p)"""
_KEYS = f"q AS (SELECT seq, document AS doc_id, page AS cited, {_squash(_fold('quote'))} AS key FROM i WHERE length({_squash(_fold('quote'))}) >= {K.LEAST_KEY})"
_EXACT = f"""{_PAGES}, {_ITEMS}, {_FEATURES}, {_KEYS},
  hits AS (SELECT q.seq, feats.page, row_number() OVER (PARTITION BY q.seq ORDER BY feats.page IS DISTINCT FROM q.cited, feats.page) AS nth
           FROM q JOIN feats USING (doc_id) WHERE contains(feats.sq, q.key)),
  found AS (SELECT seq, page FROM hits WHERE nth = 1)"""
_LIVE = "coalesce(superseded_by, '') = ''"
_TITLED = f"""{_ITEMS}, t AS (SELECT i.*, pk.base, coalesce(nullif(m.short, ''), nullif(m.title, '')) AS short
  FROM i LEFT JOIN packages pk USING (package_id) LEFT JOIN manifest_documents m ON m.id = i.document)"""
_WHERE = """CASE WHEN coalesce(end_page, 0) <> 0 THEN 'pp. ' || coalesce(page::VARCHAR, 'None') || '–' || end_page::VARCHAR ELSE 'p. ' || coalesce(page::VARCHAR, 'None') END
  || CASE WHEN len(also_on) > 0 THEN ', also p. ' || array_to_string(also_on, ', ') ELSE '' END"""
_CITE = f"CASE WHEN document IS NOT DISTINCT FROM base THEN {_WHERE} ELSE coalesce(short, document, '') || ', ' || {_WHERE} END"
_FOOT = r"[^\S\n]*(?:page[^\S\n]*)?\d{1,3}(?:[^\S\n]*of[^\S\n]*\d{1,3})?[^\S\n]*|[^\n]{0,60}\bpage[^\S\n]+\d{1,3}(?:[^\S\n]+of[^\S\n]+\d{1,3})?[^\S\n]*"
_SENT = f"""{_PAGES}, blocks AS (SELECT package_id, doc_id, role, page, unnest(string_split_regex(coalesce(text, ''), '\\n\\s*\\n')) AS b FROM p),
  marked AS (SELECT package_id, doc_id, role, page, regexp_replace({_strip(f"regexp_replace(b, '{_SPACE}+', ' ', 'g')")}, '([.;])\\s+([A-Z(])', concat('\\1', chr(1), '\\2'), 'g') AS b FROM blocks),
  s AS (SELECT package_id, doc_id AS document, role, page, text FROM (SELECT package_id, doc_id, role, page, unnest(string_split(b, chr(1))) AS text FROM marked) WHERE length(text) > 15)"""


def _dated(kind: str, live: str = "live", more: str = "") -> str:
    return f"""SELECT package_id, '{kind}' AS fact, seq, date, page{more} FROM (
      SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY amended DESC, d DESC, CASE WHEN NOT amended THEN votes END DESC NULLS LAST, CASE WHEN d THEN date END DESC NULLS LAST, seq) AS nth
      FROM (SELECT *, coalesce(date, '') <> '' AS d, coalesce(date, '') <> '' AND role = 'amendment' AS amended,
                   CASE WHEN coalesce(date, '') <> '' THEN count(*) OVER (PARTITION BY package_id, date) END AS votes
            FROM {live} WHERE kind = '{kind}')) WHERE nth = 1"""


def _first(kind: str) -> str:
    return f"SELECT package_id, '{kind}' AS fact, arg_min(seq, seq) AS seq, arg_min(coalesce(date, chr(0)), seq) AS date, arg_min(coalesce(page, -1), seq) AS page FROM live WHERE kind = '{kind}' GROUP BY package_id"


def _best(fact: str, kinds: str, rank: str, floor: int) -> str:
    return f"""SELECT package_id, '{fact}' AS fact, seq, date, page FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY r DESC, seq) AS nth
      FROM (SELECT *, {rank} AS r FROM live WHERE kind IN ({kinds})) WHERE r >= {floor}) WHERE nth = 1"""


_TEXT = "concat(coalesce(statement, ''), ' ', coalesce(quote, ''))"
_SUBMIT_RANK = f"2 * {_has(_TEXT, K.CHANNEL_WORDS)}::INT + 2 * {_has(_TEXT, K.RESPONSE_WORDS)}::INT + (kind = 'submission_method')::INT - 4 * {_has('statement', K.NOT_THE_RESPONSE)}::INT"
_AWARD_RANK = f"2 * contains(lower({_TEXT}), 'award')::INT + regexp_matches(lower({_TEXT}), '{K.AWARD_WORDS}')::INT"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
# one alternation for the dates of a text, as in the query
_DATE = "|".join([K.DATE_REVISED, K.DATE_NAMED, K.DATE_DAY_FIRST, K.DATE_NUMERIC, K.DATE_ISO])


def _date_of(y: str, m: str, d: str) -> str:
    year = f"CASE WHEN try_cast({y} AS INT) < 100 THEN try_cast({y} AS INT) + 2000 ELSE try_cast({y} AS INT) END"
    return f"try_cast(printf('%04d-%02d-%02d', {year}, try_cast({m} AS INT), try_cast({d} AS INT)) AS DATE)"


def _g(pattern: str, k: int) -> str:
    return f"regexp_extract(m, '(?i)^(?:{pattern})$', {k})"


def _is(pattern: str) -> str:
    return f"regexp_matches(m, '(?i)^(?:{pattern})$')"


def _month(g: str) -> str:
    return f"((strpos('{_MONTHS}', lower({g}[1:3])) + 2) // 3)"


_R, _N, _D, _U, _I = K.DATE_REVISED, K.DATE_NAMED, K.DATE_DAY_FIRST, K.DATE_NUMERIC, K.DATE_ISO
_ONE_MATCH = f"""CASE WHEN {_is(_R)} THEN [{_date_of(_g(_R, 4), _month(_g(_R, 1)), _g(_R, 2))}, {_date_of(_g(_R, 4), _month(_g(_R, 1)), _g(_R, 3))}]
  WHEN {_is(_N)} THEN [{_date_of(_g(_N, 3), _month(_g(_N, 1)), _g(_N, 2))}] WHEN {_is(_D)} THEN [{_date_of(_g(_D, 3), _month(_g(_D, 2)), _g(_D, 1))}]
  WHEN {_is(_U)} THEN [{_date_of(_g(_U, 3), _g(_U, 1), _g(_U, 2))}] ELSE [{_date_of(_g(_I, 1), _g(_I, 2), _g(_I, 3))}] END"""
_EMAIL = K.EMAIL.replace(r"\w", r"\pL\pM\pN_")
_EMAIL = r"[\pL\pM\pN_.+-]+@[\pL\pM\pN_-]+(?:\.[\pL\pM\pN_-]+)+"

SQL: dict[str, str] = {
    "page_records": f"WITH {_PAGES} SELECT package_id, role, count(*) AS pages, sum(length(text))::BIGINT AS chars FROM p GROUP BY ALL",
    "package_documents": """
      WITH listed AS (SELECT package_id, base AS id, 'base' AS role FROM packages WHERE base IS NOT NULL UNION ALL SELECT package_id, unnest(amendments), 'amendment' FROM packages UNION ALL SELECT package_id, unnest(attachments), 'attachment' FROM packages),
        late AS (SELECT pk.package_id, m.id, 'attachment' AS role FROM manifest_documents m JOIN packages pk ON pk.base = m.attachment_of),
        every AS (SELECT * FROM listed WHERE id IS NOT NULL UNION ALL SELECT * FROM late WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.package_id = late.package_id AND l.id = late.id))
      SELECT every.package_id, every.id, every.role, coalesce(nullif(m.short, ''), m.title) AS label FROM every LEFT JOIN manifest_documents m USING (id)""",
    "packages_without_items": "SELECT package_id, package_id IN (SELECT package_id FROM items WHERE package_id IS NOT NULL) AS has_items FROM packages",
    "page_split": f"""WITH {_PAGES}, n AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY doc_id ORDER BY page, text) AS page, row_number() OVER (PARTITION BY doc_id ORDER BY page DESC, text DESC) AS back FROM p)
      SELECT doc_id, page::INT AS page, md5(text) AS text_md5 FROM n""",
    "rendering_pairs": f"""WITH {_PAGES}, c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS here, count(*) FILTER (coalesce(reading, '') <> '') OVER (PARTITION BY doc_id) AS there FROM p),
        r AS (SELECT doc_id, page, coalesce(text, '') AS text, CASE WHEN here = there THEN coalesce(reading, '') ELSE '' END AS reading FROM c)
      SELECT doc_id, page, length(reading)::INT AS reading_chars, (length(text) + CASE WHEN reading = '' THEN 0 ELSE 20 + length(reading) END)::INT AS searchable_chars FROM r""",
    "blank_pages": f"WITH {_PAGES} SELECT doc_id, array_to_string(list_sort(list_distinct(list(page))), ',') AS blank FROM p WHERE length({_strip('text')}) < {K.BLANK_CHARS} GROUP BY doc_id",
    "chunk_pack": f"""
      WITH RECURSIVE {_PAGES}, s AS (SELECT doc_id, page, length({_strip('text')}) AS n FROM p), o AS (SELECT doc_id, page, n + {K.CHUNK_OVERHEAD} AS block, row_number() OVER (PARTITION BY doc_id ORDER BY page, n) AS nth FROM s WHERE n > 0),
        fold AS (SELECT doc_id, nth, page, block AS size, 0 AS chunk FROM o WHERE nth = 1
          UNION ALL SELECT o.doc_id, o.nth, o.page, CASE WHEN f.size + o.block > {K.CHUNK_CHARS} THEN o.block ELSE f.size + o.block END, CASE WHEN f.size + o.block > {K.CHUNK_CHARS} THEN f.chunk + 1 ELSE f.chunk END
          FROM fold f JOIN o ON o.doc_id = f.doc_id AND o.nth = f.nth + 1)
      SELECT doc_id, chunk::INT AS chunk_idx, string_agg(page::VARCHAR, ',' ORDER BY nth) AS pages FROM fold GROUP BY doc_id, chunk""",
    "footer_trim": f"""WITH {_PAGES}, f AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(text, ''), '{_SPACE}+$', ''), '(?i)(?:(?:^|\\n)(?:[^\\S\\n]*|{_FOOT}))+$', '') AS t FROM p)
      SELECT page_id, length(t)::INT AS chars, md5(t) AS text_md5 FROM f""",
    "content_hash": f"WITH {_PAGES} SELECT sha256(text) AS sha256, count(*) AS pages, min(page_id) AS first_page FROM p GROUP BY 1",
    "package_roles": """WITH c AS (SELECT package_id, count(DISTINCT doc_id) FILTER (role = 'base') AS bases, count(DISTINCT doc_id) FILTER (role = 'amendment') AS amendments, count(DISTINCT doc_id) FILTER (role = 'attachment') AS attachments FROM pages GROUP BY 1)
      SELECT *, bases = 1 AS valid FROM c""",
    "word_counts": f"SELECT word, count(*) AS n FROM (SELECT unnest({_words('text')}) AS word FROM documents) GROUP BY word",
    "squash_text": f"WITH {_ITEMS} SELECT seq, md5({_squash('quote')}) AS squashed_md5, len({_words('quote')})::BIGINT AS words FROM i",
    "sentence_split": f"WITH {_SENT} SELECT document, page, count(*) AS sentences, sum(length(text))::BIGINT AS chars FROM s GROUP BY ALL",
    "html_escaped": f"""WITH {_ITEMS}, b AS (SELECT id, title AS text FROM manifest_documents UNION ALL SELECT seq::VARCHAR, statement FROM i)
      SELECT id, replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM b""",
    "file_names": "SELECT id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(coalesce(title, ''), '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+', ''), '[-.]+$', '')[1:60], ''), 'document') AS name FROM manifest_documents",
    "keyword_flags": f"WITH {_SENT} SELECT document, " + ", ".join(f"count(*) FILTER ({_has('text', p)}) AS {k}" for k, p in K.KEYWORDS.items()) + " FROM s GROUP BY document",
    "find_dates": f"""WITH {_ITEMS}, x AS (SELECT seq, list_filter(flatten(list_transform(regexp_extract_all(translate(regexp_replace(coalesce(quote, ''), '\\p{{Zs}}', ' ', 'g'), '０１２３４５６７８９', '0123456789'), '(?i){_DATE}'), lambda m: {_ONE_MATCH})), lambda d: d IS NOT NULL) AS ds FROM i)
      SELECT seq, array_to_string(list_transform(list_filter(ds, lambda d, k: list_position(ds, d) = k), lambda d: strftime(d, '%Y-%m-%d')), ',') AS dates FROM x""",
    "display_dates": f"""WITH {_ITEMS}, x AS (SELECT seq, CASE WHEN regexp_matches(trim(coalesce(date, '')), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast(trim(date) AS DATE) END AS d, try_cast(split_part(coalesce(time, ''), ':', 1) AS INT) AS h, try_cast(split_part(coalesce(time, ''), ':', 2) AS INT) AS m FROM i)
      SELECT seq, CASE WHEN d IS NULL THEN 'Not found' ELSE strftime(d, '%B %-d, %Y') || CASE WHEN h IS NOT NULL AND m IS NOT NULL THEN printf(', %d:%02d %s', CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END, m, CASE WHEN h >= 12 THEN 'PM' ELSE 'AM' END) ELSE '' END END AS long,
        coalesce(strftime(d, '%b %-d, %Y'), 'Not stated') AS short FROM x""",
    "quote_exact": f"WITH {_EXACT} SELECT seq, page FROM found",
    "quote_status": f"""WITH {_EXACT} SELECT i.model, CASE WHEN f.page IS NULL THEN 'open' WHEN f.page IS NOT DISTINCT FROM i.page THEN 'exact' ELSE 'moved' END AS status, count(*) AS items FROM i LEFT JOIN found f USING (seq) GROUP BY ALL""",
    "quote_overlap": f"""WITH {_PAGES}, {_ITEMS}, q AS (SELECT seq, document AS doc_id, page, list_distinct({_words('quote')}) AS qw FROM i), w AS (SELECT doc_id, page, {_words('text')} AS pw FROM p)
      SELECT seq, round_even(len(list_intersect(qw, pw)) / len(qw), 6) AS overlap FROM q JOIN w USING (doc_id, page) WHERE len(qw) > 0""",
    "coerce_replies": f"""WITH {_ITEMS}, c AS (SELECT seq, kind, {_strip('statement')} AS st, {_strip('quote')} AS qt, page FROM i)
      SELECT seq, kind, md5(st) AS statement_md5, md5(qt) AS quote_md5, page::BIGINT AS page FROM c WHERE qt <> '' AND kind IN ({', '.join(repr(k) for k in K.KINDS)})""",
    "reclassified": f"""WITH {_ITEMS}, a AS (SELECT *, coalesce(statement, '') AS s FROM i), w AS (SELECT *, regexp_extract(s, '(?i){K.KEYWORDS['questions']}') AS qw, regexp_extract(s, '(?i){K.RESPONSE_WORDS}') AS rw FROM a),
        pos AS (SELECT *, CASE WHEN qw = '' THEN 0 ELSE length(string_split_regex(s, '(?i){K.KEYWORDS['questions']}')[1]) + 1 END AS q, CASE WHEN rw = '' THEN 0 ELSE length(string_split_regex(s, '(?i){K.RESPONSE_WORDS}')[1]) + 1 END AS r FROM w),
        k1 AS (SELECT *, CASE WHEN kind = 'response_due' AND q > 0 AND (r = 0 OR q < r) THEN 'questions_due' ELSE kind END AS a1 FROM pos),
        k2 AS (SELECT *, CASE WHEN a1 IN ('response_due', 'questions_due') AND coalesce(date, '') = '' THEN 'other_deadline' ELSE a1 END AS a2 FROM k1),
        k3 AS (SELECT *, CASE WHEN a2 IN ({', '.join(repr(k) for k in K.GENERAL_KINDS)}) AND regexp_matches(s, '(?i){K.NAICS_CODE}') THEN 'naics' WHEN a2 IN ({', '.join(repr(k) for k in K.GENERAL_KINDS)}) AND regexp_matches(s, '(?i){K.SET_ASIDE_WORDS}') THEN 'set_aside' ELSE a2 END AS a3 FROM k2)
      SELECT seq, CASE WHEN a3 = 'evaluation_factor' AND regexp_matches(s, '(?i){K.GOALS}') THEN 'participation_goal' ELSE a3 END AS kind FROM k3""",
    "amendments": f"""WITH {_ITEMS}, l AS (SELECT package_id, kind, document, date, row_number() OVER (PARTITION BY package_id, kind ORDER BY date DESC, seq) AS nth FROM i WHERE kind IN ({', '.join(repr(k) for k in K.DEADLINE_KINDS)}) AND role = 'amendment' AND coalesce(date, '') <> '')
      SELECT i.seq, l.document AS superseded_by FROM i JOIN l ON l.package_id = i.package_id AND l.kind = i.kind AND l.nth = 1 WHERE i.role = 'base' AND coalesce(i.date, '') <> '' AND i.date <> l.date""",
    "equal_quotes": f"""WITH {_ITEMS}, g AS (SELECT min(seq) AS seq, count(*) AS items, list_sort(list_distinct(list(page) FILTER (page IS NOT NULL))) AS pages FROM (SELECT *, {_squash('quote')} AS q FROM i) WHERE q <> '' GROUP BY package_id, kind, document, q)
      SELECT seq, items, array_to_string(coalesce(pages, []), ',') AS pages FROM g WHERE items > 1""",
    "key_facts": f"""WITH {_ITEMS}, live AS (SELECT * FROM i WHERE {_LIVE} AND verification IS DISTINCT FROM 'missing'), f AS ({_dated('response_due')} UNION ALL {_dated('questions_due')} UNION ALL {_best('submission_method', "'submission_method', 'response_due'", _SUBMIT_RANK, 3)}
        UNION ALL {_best('basis_of_award', "'basis_of_award'", _AWARD_RANK, 0)} UNION ALL {_first('page_limit')} UNION ALL {_first('set_aside')} UNION ALL {_first('naics')}
        UNION ALL SELECT package_id, 'evaluation_factors', seq, date, page FROM live WHERE kind = 'evaluation_factor')
      SELECT package_id, fact, seq, nullif(date, chr(0)) AS date, CASE WHEN page = -1 THEN NULL ELSE page END AS page FROM f""",
    "report_stats": f"""WITH {_ITEMS} SELECT package_id, count(*) FILTER ({_LIVE} AND verification IS DISTINCT FROM 'missing') AS kept, count(*) FILTER (NOT ({_LIVE})) AS superseded, count(*) FILTER (verification = 'missing') AS rejected,
        count(*) FILTER (verification = 'exact') AS exact, count(*) FILTER (verification = 'fuzzy') AS fuzzy, count(*) FILTER (verification = 'assembled') AS assembled, count(*) FILTER (len(warnings) > 0) AS warnings FROM i GROUP BY package_id""",
    "category_sections": f"WITH {_ITEMS}, c AS (SELECT package_id, {_CATEGORY} AS category, count(*) AS items FROM i GROUP BY ALL) SELECT package_id, category, items, ({_SECTION})::BIGINT AS section FROM c",
    "stats_by_model": f"""WITH {_ITEMS}, g AS (SELECT model, package_id, count(*) FILTER (verification IN ('exact', 'fuzzy', 'assembled')) AS verified, count(*) AS items FROM i GROUP BY ROLLUP (model, package_id))
      SELECT *, CASE WHEN items = 0 THEN '0%' ELSE printf('%d/%d (%d%%)', verified, items, round_even(100.0 * verified / items, 0)::INT) END AS share FROM g""",
    "redact_contacts": f"""WITH {_ITEMS}, r AS (SELECT seq, quote, regexp_replace(regexp_replace(coalesce(quote, ''), '{_EMAIL}', '[email]', 'g'), '(?i){K.PHONE}', '[phone]', 'g') AS redacted FROM i) SELECT seq, redacted FROM r WHERE redacted <> quote""",
    "cite_labels": f"WITH {_TITLED} SELECT seq, {_CITE} AS label FROM t",
    "markdown_items": f"""WITH {_TITLED}, l AS (SELECT package_id, {_CATEGORY} AS category, seq,
          list_concat(['- [ ] ' || CASE WHEN {_LIVE} THEN '' ELSE '~~' END || coalesce(statement, '') || CASE WHEN {_LIVE} THEN '' ELSE '~~' END || CASE WHEN coalesce(weight, '') <> '' THEN ' **' || weight || '**' ELSE '' END || ' (' || {_CITE} || ')',
            '  > ' || coalesce(quote, '')], list_transform(coalesce(warnings, []), lambda w: '  - Check: ' || w)) AS ls FROM t)
      SELECT package_id, ({_SECTION})::BIGINT AS section, seq, (unnest(range(len(ls))))::BIGINT AS nth, unnest(ls) AS line FROM l""",
}


_T = "translate(regexp_replace(coalesce({}, ''), '\\p{{Zs}}', ' ', 'g'), '０１２３４５６７８９', '0123456789')"


def _dates(c: str) -> str:
    """The dates of a text as a list of ISO strings, as in ``find_dates``."""
    found = f"list_filter(flatten(list_transform(regexp_extract_all({_T.format(c)}, '(?i){_DATE}'), lambda m: {_ONE_MATCH})), lambda d: d IS NOT NULL)"
    return f"list_transform(list_filter({found}, lambda d, k: list_position({found}, d) = k), lambda d: strftime(d, '%Y-%m-%d'))"


def _times(c: str) -> str:
    """The times of a text. What a lookahead excludes in the query is matched along here and taken off."""
    t, two = _T.format(c), "'%02d:%02d'"
    hour = "regexp_extract(m, '^[0-9]+')::INT"
    late = "regexp_matches(m, '(?i)^[0-9]+(?::[0-9]+)?\\s*p')::INT"
    minute = "coalesce(try_cast(nullif(regexp_extract(m, '^[0-9]+:([0-9]{2})', 1), '') AS INT), 0)"
    twelve = f"list_transform(list_filter(regexp_extract_all({t}, '(?i)\\b\\d{{1,2}}(?::\\d{{2}})?\\s*(?:a\\.?\\s?m\\.?|p\\.?\\s?m\\.?)(?:[^a-zA-Z]|$)'), lambda m: {hour} BETWEEN 1 AND 12), lambda m: printf({two}, {hour} % 12 + 12 * {late}, {minute}))"
    clock = "lpad(regexp_extract(m, '^([0-9]{1,2}):?([0-9]{2})', 1), 2, '0') || ':' || regexp_extract(m, '^([0-9]{1,2}):?([0-9]{2})', 2)"
    day = f"list_transform(list_filter(regexp_extract_all({t}, '(?i)\\b(?:[01]?\\d|2[0-3]):[0-5]\\d\\b(?:\\s*(?:a\\.?m|p\\.?m))?'), lambda m: NOT regexp_matches(m, '(?i)m$')), lambda m: {clock})"
    military = f"list_transform(regexp_extract_all({t}, '{K.TIME_MILITARY}'), lambda m: {clock})"
    every = f"list_concat({twelve}, {day}, {military}, CASE WHEN regexp_matches({t}, '(?i){K.NOON}') THEN ['12:00'] ELSE [] END)"
    return f"list_filter({every}, lambda x, k: list_position({every}, x) = k)"


def _escaped(c: str) -> str:
    return f"replace(replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


_LEAD = f"""{_ITEMS}, lead AS (SELECT model FROM i GROUP BY model ORDER BY count(*) DESC, model LIMIT 1), ref AS (SELECT * FROM i WHERE model = (SELECT model FROM lead)), oth AS (SELECT * FROM i WHERE model IS DISTINCT FROM (SELECT model FROM lead)),
  rl AS (SELECT * FROM ref WHERE {_LIVE}), ol AS (SELECT * FROM oth WHERE {_LIVE})"""
_MORE = ", statement, quote, time"
_SCORED = f"""{_LEAD}, gold AS ({_dated('response_due', 'rl', _MORE)} UNION ALL {_dated('questions_due', 'rl', _MORE)}), got AS ({_dated('response_due', 'ol', _MORE)} UNION ALL {_dated('questions_due', 'ol', _MORE)}),
  b AS (SELECT coalesce(gold.package_id, got.package_id) AS package_id, coalesce(gold.fact, got.fact) AS fact, gold.fact IS NOT NULL AS stated, got.fact IS NOT NULL AS there, coalesce(gold.date, '') AS date, coalesce(gold.time, '') AS time, lower(gold.statement) AS phrase,
      coalesce(got.date, '') AS got_date, coalesce(got.time, '') AS got_time, lower(concat(coalesce(got.statement, ''), ' ', coalesce(got.quote, ''))) AS t FROM gold FULL JOIN got ON gold.package_id IS NOT DISTINCT FROM got.package_id AND gold.package_id IS NOT NULL AND gold.fact = got.fact),
  sc AS (SELECT *, CASE WHEN NOT stated THEN NOT there WHEN NOT there THEN false WHEN date <> '' THEN got_date = date ELSE coalesce(contains(t, phrase), false) END AS correct, CASE WHEN stated AND there AND date <> '' AND time <> '' THEN got_time = time END AS time_correct,
      CASE WHEN NOT stated THEN 'not stated' WHEN date <> '' THEN date ELSE coalesce(phrase, '') END AS expected FROM b)"""
_LINES = f"""ln AS (SELECT package_id, seq AS id, statement, list_sort(list_transform(list_distinct({_words('statement')}), lambda w: {{'l': -length(w), 'w': w}}))[1:3] AS l FROM ref), lines AS (SELECT * FROM ln WHERE len(l) = 3),
  cl AS (SELECT lines.package_id, id, any_value(statement) AS statement, coalesce(bool_or(contains(o.t, l[1].w) AND (contains(o.t, l[2].w) OR contains(o.t, l[3].w))), false) AS found
    FROM lines LEFT JOIN (SELECT package_id, lower(concat(coalesce(statement, ''), ' ', coalesce(quote, ''))) AS t FROM oth) o ON o.package_id = lines.package_id GROUP BY lines.package_id, id)"""
_FACTORS = f"""ft AS (SELECT package_id, lower(concat(coalesce(statement, ''), ' ', coalesce(quote, ''))) AS t, weight FROM oth WHERE kind = 'evaluation_factor'),
  fl AS (SELECT package_id, seq AS id, ({_words('statement')})[1] AS name, CASE WHEN coalesce(weight, '') <> '' THEN lower(weight) END AS weight FROM ref WHERE kind = 'evaluation_factor'),
  fs AS (SELECT fl.package_id, id, coalesce(bool_or(contains(ft.t, name) AND (fl.weight IS NULL OR contains(concat(coalesce(ft.weight, ''), ' ', ft.t), fl.weight))), false) AS found FROM fl LEFT JOIN ft ON ft.package_id = fl.package_id GROUP BY fl.package_id, id)"""
_NAME = K.NAME.replace("'", "''")
_NAMED = f"list_filter(list_concat(labelled, list_filter(dotted, lambda n: NOT list_contains(labelled, n))), lambda n: length(n) > 4 AND len(string_split_regex(n, '\\s+')) >= 2)"
_NAMES = rf"""{_ITEMS}, raw AS (SELECT package_id, seq, quote, list_distinct(list_transform(regexp_extract_all(coalesce(quote, ''), '\b{K.CONTACT_LABEL}(\s*(?:is|:|-|,)?\s*)({_NAME})', 3), lambda n: trim(n))) AS labelled,
    list_transform(list_filter(list_transform(regexp_extract_all(coalesce(quote, ''), '{_EMAIL}'), lambda m: list_filter(string_split_regex(string_split(m, '@')[1], '[._]'), lambda x: regexp_matches(x, '^\p{{L}}{{2,}}$'))), lambda q: len(q) >= 2), lambda q: q[1] || ' ' || q[2]) AS dotted FROM i),
  named AS (SELECT package_id, seq, quote, unnest(list_distinct({_NAMED})) AS name FROM raw)""".replace("\\", "\\")
_PAGED = f"""{_PAGES}, sp AS (SELECT package_id, doc_id, role, page, list_filter(flatten(list_transform(string_split_regex(coalesce(text, ''), '\\n\\s*\\n'), lambda b: string_split(regexp_replace({_strip(f"regexp_replace(b, '{_SPACE}+', ' ', 'g')")}, '([.;])\\s+([A-Z(])', concat('\\1', chr(1), '\\2'), 'g'), chr(1)))), lambda x: length(x) > 15) AS l FROM p),
  s0 AS (SELECT package_id, doc_id AS document, role, page, unnest(l) AS text, generate_subscripts(l, 1) AS nth FROM sp)"""
_GIVEN = """gv AS (SELECT package_id, unnest(list_concat([base], coalesce(amendments, []), coalesce(attachments, []))) AS document, generate_subscripts(list_concat([base], coalesce(amendments, []), coalesce(attachments, [])), 1) AS o FROM packages), go AS (SELECT package_id, document, min(o) AS o FROM gv WHERE document IS NOT NULL GROUP BY ALL)"""
_K = K.KEYWORDS


def _baseline() -> str:
    simple = {"submission_method": "submit AND channel", "page_limit": "page_limit AND limit_word", "basis_of_award": "basis", "set_aside": "set_aside", "naics": "naics"}
    flags = ", ".join(f"{_has('text', p)} AS {k}" for k, p in _K.items())
    pick = lambda kind, where, dated: f"""SELECT package_id, '{kind}' AS kind, arg_min(text, pos) AS text, arg_min(page, pos) AS page, arg_min(document, pos) AS document, {'arg_min(role, pos)' if dated else "'base'"} AS role,
        {"coalesce(arg_min(ds, pos)[1], '')" if dated else "''"} AS date, {"coalesce(arg_min(ts, pos)[1], '')" if dated else "''"} AS time, '' AS weight FROM {'x' if not dated else 'y'} WHERE {where} GROUP BY package_id"""  # noqa: E731
    facts = " UNION ALL ".join(pick(k, w, False) for k, w in simple.items())
    rated = "points AND evaluation"
    return f"""WITH {_PAGED}, {_GIVEN}, x AS (SELECT s0.*, {{'a': role IS DISTINCT FROM 'amendment', 'u': o IS NULL, 'o': coalesce(o, 0), 'd': s0.document, 'p': s0.page, 'n': nth}} AS pos, {flags} FROM s0 LEFT JOIN go USING (package_id, document)),
      y AS (SELECT * FROM (SELECT *, {_dates('text')} AS ds, {_times('text')} AS ts FROM x WHERE due) WHERE len(ds) > 0), q AS (SELECT package_id, min(pos) AS pos FROM y WHERE questions GROUP BY package_id),
      f AS (SELECT package_id, CASE WHEN {rated} THEN 'evaluation_factor' ELSE 'required_content' END AS kind, text, page, document, 'base' AS role, '' AS date, '' AS time, CASE WHEN {rated} THEN regexp_extract(text, '(?i){_K['points']}') ELSE '' END AS weight FROM x WHERE ({rated}) OR obligation
        UNION ALL {facts} UNION ALL {pick('questions_due', 'questions', True)} UNION ALL {pick('response_due', 'response AND (SELECT q.pos FROM q WHERE q.package_id IS NOT DISTINCT FROM y.package_id) IS DISTINCT FROM pos', True)})
      SELECT package_id, kind, document, page, role, date, time, weight, md5(text[1:220]) AS statement_md5 FROM f"""


_REQUEST = "'Document: ' || doc_id || chr(10) || 'Pages ' || {a}::VARCHAR || ' to ' || {b}::VARCHAR || chr(10) || chr(10)"
_FACT_ORDER = "['response_due', 'questions_due', 'submission_method', 'page_limit', 'basis_of_award', 'set_aside', 'naics']"
_LONG = """CASE WHEN d IS NULL THEN coalesce(statement, '') ELSE strftime(d, '%B %-d, %Y') || CASE WHEN h IS NOT NULL AND m IS NOT NULL THEN printf(', %d:%02d %s', CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END, m, CASE WHEN h >= 12 THEN 'PM' ELSE 'AM' END) ELSE '' END END"""

SQL |= {
    "find_times": f"WITH {_ITEMS} SELECT seq, array_to_string({_times('quote')}, ',') AS times FROM i",
    "check_dates": f"""WITH {_ITEMS}, x AS (SELECT seq, kind, quote, coalesce(date, '') AS dt, date, coalesce(time, '') AS tm, CASE WHEN regexp_matches(trim(coalesce(date, '')), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast(trim(date) AS DATE) END AS d, {_dates('quote')} AS ds, {_times('quote')} AS ts FROM i)
      SELECT seq, CASE WHEN dt <> '' AND d IS NULL THEN '' ELSE date END AS date, array_to_string(list_filter([CASE WHEN dt <> '' AND d IS NULL THEN 'Unreadable date ''' || dt || ''' removed.' END,
        CASE WHEN d IS NOT NULL AND len(ds) > 0 AND NOT list_contains(ds, strftime(d, '%Y-%m-%d')) THEN 'Date ' || strftime(d, '%Y-%m-%d') || ' is not among the dates quoted (' || array_to_string(ds, ', ') || ').' END,
        CASE WHEN kind IN ({', '.join(repr(k) for k in K.DEADLINE_KINDS)}) AND len(ds) >= 2 AND (regexp_matches(quote, '(?i){K.DATE_REVISED}') OR regexp_matches(quote, '{K.NUMERIC_REVISION}')) THEN 'Two dates side by side: the first may be struck through.' END,
        CASE WHEN tm <> '' AND len(ts) > 0 AND NOT list_contains(ts, tm) THEN 'Time ' || tm || ' is not among the times quoted (' || array_to_string(ts, ', ') || ').' END], lambda w: w IS NOT NULL), ' ') AS warnings FROM x""",
    "chunk_texts": SQL["chunk_pack"].split("SELECT doc_id, chunk::INT AS chunk_idx")[0] + f"""
      , tx AS (SELECT f.doc_id, f.chunk::INT AS chunk_idx, string_agg('<<<PAGE ' || f.page::VARCHAR || '>>>' || chr(10) || {_strip('p.text')}, chr(10) || chr(10) ORDER BY f.nth) AS t FROM fold f JOIN p ON p.doc_id = f.doc_id AND p.page = f.page GROUP BY ALL)
      SELECT doc_id, chunk_idx, length(t)::INT AS chars, t IN (SELECT text FROM chunks WHERE text IS NOT NULL) AS stored FROM tx""",
    "nfkc_squash": f"WITH {_ITEMS} SELECT seq, md5({_squash(_fold('quote'))}) AS squashed_md5 FROM i",
    "cross_page": f"""WITH {_PAGES}, bd AS (SELECT doc_id, page, CASE WHEN coalesce(reading, '') = '' THEN coalesce(text, '') ELSE coalesce(text, '') || chr(10) || 'zzrenderingbreakzz' || chr(10) || reading END AS body FROM p),
        f AS (SELECT doc_id, page, {_squash(_fold("regexp_replace(regexp_replace(body, '" + _SPACE + "+$', ''), '(?i)(?:(?:^|" + chr(92) + "n)(?:[^" + chr(92) + "S" + chr(92) + "n]*|" + _FOOT + "))+$', '')"))} AS cut, {_squash(_fold('body'))} AS sq FROM bd),
        n AS (SELECT *, lead(page) OVER w AS then_, lead(sq) OVER w AS nx FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
        q AS (SELECT concat_ws('#', doc_id, page::VARCHAR) AS place, doc_id, right(cut, 20) || left(nx, 20) AS key FROM n WHERE then_ = page + 1), k AS (SELECT * FROM q WHERE length(key) >= {K.LEAST_KEY})
      SELECT k.place, min(n.page) AS page FROM k JOIN n ON n.doc_id = k.doc_id AND n.then_ = n.page + 1 AND contains(n.cut || n.nx, k.key) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = k.doc_id AND contains(f.sq, k.key)) GROUP BY k.place""",
    "score_facts": f"WITH {_SCORED} SELECT package_id, fact, correct, time_correct, expected FROM sc",
    "score_verdicts": f"WITH {_SCORED} SELECT fact, CASE WHEN correct AND coalesce(time_correct, true) THEN 'yes' WHEN correct THEN 'date only' ELSE 'no' END AS verdict, count(*) AS n FROM sc GROUP BY ALL",
    "score_totals": f"""WITH {_SCORED}, t AS (SELECT package_id, count(*) FILTER (correct) AS facts_correct, count(*) AS facts_total, count(*) FILTER (time_correct) AS times_correct, count(time_correct) AS times_total FROM sc GROUP BY ROLLUP (package_id))
      SELECT *, CASE WHEN facts_total = 0 THEN '0%' ELSE printf('%d/%d (%d%%)', facts_correct, facts_total, round_even(100.0 * facts_correct / facts_total, 0)::INT) END AS share FROM t""",
    "score_checklist": f"WITH {_LEAD}, {_LINES} SELECT package_id, id, found FROM cl",
    "missed_lines": f"WITH {_LEAD}, {_LINES} SELECT package_id, id, md5(statement) AS text_md5 FROM cl WHERE NOT found",
    "score_factors": f"WITH {_LEAD}, {_FACTORS} SELECT package_id, id, found FROM fs",
    "evaluation_results": f"""WITH {_SCORED}, {_LINES}, {_FACTORS}, e AS (SELECT package_id, correct AS f, time_correct AS t, NULL::BOOLEAN AS x, NULL::BOOLEAN AS c, NULL::BOOLEAN AS n FROM sc UNION ALL SELECT package_id, NULL, NULL, found, NULL, NULL FROM fs UNION ALL SELECT package_id, NULL, NULL, NULL, found, NULL FROM cl UNION ALL SELECT package_id, NULL, NULL, NULL, NULL, true FROM ol)
      SELECT package_id, count(*) FILTER (f) AS facts_correct, count(f) AS facts_total, count(*) FILTER (t) AS times_correct, count(t) AS times_total, count(*) FILTER (x) AS factors_found, count(x) AS factors_total, count(*) FILTER (c) AS checklist_found, count(c) AS checklist_total, count(n) AS items FROM e GROUP BY ROLLUP (package_id)""",
    "contact_names": f"WITH {_NAMES} SELECT package_id, name, count(*) AS n FROM named GROUP BY ALL",
    "redact_names": rf"""WITH {_NAMES}, per AS (SELECT package_id, list_transform(list_sort(list({{'l': -length(name), 'n': name}})), lambda x: x.n) AS names FROM (SELECT DISTINCT package_id, name FROM named) GROUP BY package_id),
        a AS (SELECT i.seq, i.quote, regexp_replace(regexp_replace(i.quote, '{_EMAIL}', '[email]', 'g'), '(?i){K.PHONE}', '[phone]', 'g') AS t, coalesce(per.names, []) AS names FROM i LEFT JOIN per ON per.package_id = i.package_id),
        b AS (SELECT seq, list_reduce(list_concat([t], names), lambda t, n: regexp_replace(t, '\b' || array_to_string(list_transform(string_split_regex(n, '\s+'), lambda x: replace(x, '.', '\.')), '[\s.]+') || '\b', '[name]', 'gi')) AS t FROM a),
        c AS (SELECT seq, regexp_replace(regexp_replace(t, '\b{K.CONTACT_LABEL}(\s*(?:is|:|-|,)?\s+|\s*(?:is|:|-|,))({_NAME})', '\1\2[name]', 'g'), '\b{K.CONTACT_LABEL}({_NAME})', '\1 [name]', 'g') AS t FROM b),
        d AS (SELECT seq, regexp_replace(t, '\b{_NAME}(\s+(?:at|:|,)?\s*\[email\])', '[name]\1', 'g') AS t FROM c)
      SELECT seq, md5(t) AS redacted_md5, contains(t, '[name]') AS has_name FROM d""",
    "keyword_baseline": _baseline(),
    "html_items": f"""WITH {_TITLED}, x AS (SELECT *, {_CATEGORY} AS category FROM t) SELECT package_id, ({_SECTION})::INT AS section, seq, '<li>' || CASE WHEN {_LIVE} THEN {_escaped('statement')} ELSE '<s>' || {_escaped('statement')} || '</s>' END || ' <span class="badge">' || {_escaped('verification')} || '</span> <cite>' || {_escaped(_CITE)} || '</cite><blockquote>' || {_escaped('quote')} || '</blockquote>'
        || array_to_string(list_transform(coalesce(warnings, []), lambda w: '<p>Check: ' || {_escaped('w')} || '</p>'), '') || '</li>' AS line FROM x""",
    "markdown_report": f"""WITH {_ITEMS}, live AS (SELECT * FROM i WHERE {_LIVE} AND verification IS DISTINCT FROM 'missing'), kf AS ({_dated('response_due')} UNION ALL {_dated('questions_due')} UNION ALL {_best('submission_method', "'submission_method', 'response_due'", _SUBMIT_RANK, 3)}
          UNION ALL {_best('basis_of_award', "'basis_of_award'", _AWARD_RANK, 0)} UNION ALL {_first('page_limit')} UNION ALL {_first('set_aside')} UNION ALL {_first('naics')}),
        heads AS (SELECT pk.package_id, coalesce(nullif(pk.title, ''), m.title, pk.base, '') AS title FROM packages pk LEFT JOIN manifest_documents m ON m.id = pk.base),
        t AS (SELECT i.*, pk.base, coalesce(nullif(m.short, ''), nullif(m.title, '')) AS short FROM i LEFT JOIN packages pk USING (package_id) LEFT JOIN manifest_documents m ON m.id = i.document),
        top AS (SELECT package_id, 0 AS part, 0 AS section, 0 AS seq, unnest(range(6)) AS nth, unnest(['# ' || title, '', 'Generated 2026-01-01 with all models. Every item quotes the page it cites.', '', '## Key facts', '']) AS line FROM heads),
        every AS (SELECT package_id, unnest(range(7)) AS section, unnest({_FACT_ORDER}) AS fact, unnest(['Response due', 'Questions due', 'Submit', 'Page limit', 'Basis of award', 'Set-aside', 'NAICS']) AS label FROM heads),
        fx AS (SELECT every.*, t.seq AS own, t.* EXCLUDE (package_id), CASE WHEN regexp_matches(trim(coalesce(t.date, '')), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast(trim(t.date) AS DATE) END AS d, try_cast(split_part(coalesce(t.time, ''), ':', 1) AS INT) AS h, try_cast(split_part(coalesce(t.time, ''), ':', 2) AS INT) AS m
          FROM every LEFT JOIN kf ON kf.package_id = every.package_id AND kf.fact = every.fact LEFT JOIN t ON t.seq = kf.seq),
        fl AS (SELECT package_id, 1 AS part, section, 0 AS seq, 0 AS nth, '- **' || label || ':** ' || CASE WHEN own IS NULL THEN 'Not found' WHEN fact IN ('response_due', 'questions_due') THEN {_LONG} ELSE coalesce(statement, '') END || CASE WHEN own IS NULL THEN '' ELSE ' (' || {_CITE} || ')' END AS line FROM fx),
        k AS (SELECT *, {_CATEGORY} AS category FROM t WHERE verification IS DISTINCT FROM 'missing'), l AS (SELECT package_id, category, seq,
          list_concat(['- [ ] ' || CASE WHEN {_LIVE} THEN '' ELSE '~~' END || coalesce(statement, '') || CASE WHEN {_LIVE} THEN '' ELSE '~~' END || CASE WHEN coalesce(weight, '') <> '' THEN ' **' || weight || '**' ELSE '' END || ' (' || {_CITE} || ')',
            '  > ' || coalesce(quote, '')], list_transform(coalesce(warnings, []), lambda w: '  - Check: ' || w)) AS ls FROM k),
        hd AS (SELECT DISTINCT package_id, category FROM k),
        gone AS (SELECT * FROM i WHERE verification = 'missing')
      SELECT package_id, part::BIGINT AS part, section::BIGINT AS section, seq, nth::BIGINT AS nth, line FROM (
        SELECT * FROM top UNION ALL SELECT * FROM fl
        UNION ALL SELECT package_id, 2, {_SECTION}, -1, unnest(range(3)), unnest(['', '## ' || {_case({c: "'" + t.replace("'", "''") + "'" for c, t in K.CATEGORY_TITLES.items()}, 'category', "''")}, '']) FROM hd
        UNION ALL SELECT package_id, 2, {_SECTION}, seq, unnest(range(len(ls))), unnest(ls) FROM l
        UNION ALL SELECT package_id, 3, 0, -1, unnest(range(3)), unnest(['', '## Removed: quote not found in the document', '']) FROM (SELECT DISTINCT package_id FROM gone)
        UNION ALL SELECT package_id, 3, 0, seq, 0, '- ' || coalesce(statement, '') || ' (claimed p. ' || coalesce(cited_page::VARCHAR, 'None') || ')' FROM gone)""",
    "cached_requests": f"""WITH c AS (SELECT chunk_id, doc_id, text, length({_REQUEST.format(a='pages[1]', b='pages[-1]')} || text) AS n FROM chunks WHERE len(pages) > 0),
        s AS (SELECT chunk_id, doc_id, unnest(list_filter(string_split(regexp_replace(text, '<<<PAGE (\\d+)>>>\\n', concat(chr(1), '\\0'), 'g'), chr(1)), lambda x: x <> '')) AS part FROM c WHERE n > 4800),
        g AS (SELECT chunk_id, count(*) OVER (PARTITION BY chunk_id) = 1 AS same, length({_REQUEST.format(a="regexp_extract(part, '^<<<PAGE ([0-9]+)>>>', 1)", b="regexp_extract(part, '^<<<PAGE ([0-9]+)>>>', 1)")} || regexp_replace(part, '\\n+$', '')) AS n FROM s),
        a AS (SELECT chunk_id, n, n > 4800 AS big, false AS single FROM c UNION ALL SELECT chunk_id, n, n > 9600 OR same, true FROM g)
      SELECT chunk_id, count(*) AS requests, count(*) FILTER (big AND NOT single) AS too_long, count(*) FILTER (big AND single) AS lost, sum(n) FILTER (NOT big)::BIGINT AS chars FROM a GROUP BY chunk_id""",
    "landed_items": f"""WITH {_ITEMS} SELECT strftime(time_bucket(INTERVAL 7 DAY, extracted_at, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS week, model, count(*) AS items, count(*) FILTER (verification = 'missing') AS missing FROM i WHERE extracted_at IS NOT NULL GROUP BY ALL""",
}
SQL["request_counters"] = SQL["cached_requests"].split("SELECT chunk_id, count(*) AS requests")[0] + """SELECT count(*) AS requests, count(*) AS hits, 0::BIGINT AS misses, count(*) FILTER (big AND NOT single) AS too_long,
        count(*) FILTER (big AND single) AS failed FROM a"""
