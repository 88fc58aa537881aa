"""The same queries in SQL, for the registered tables; written independently of the operators."""

from __future__ import annotations

from lithoflow import policy as P

SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
WORD = r"[\p{L}\p{N}_]+"
DOI = r"10\.\d{4,9}/[^\s\"''<>]+"
MONTHS = "[" + ", ".join(f"'{m}'" for m in P.MONTH_NAMES) + "]"

LAST = "last AS (SELECT record_id, doc_id, sample_idx FROM records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY received_at DESC NULLS LAST, delivery_id DESC) = 1)"
DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def norm0(x: str) -> str:
    return f"lower(regexp_replace({x}, '{SPACE}', '', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '</?su[bp]>', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({strip(x)}), '{WORD}')"


def shingles(x: str) -> str:
    return f"list_distinct([array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)])".replace("w[", f"({x})[").replace("len(w)", f"len({x})")


def tokens(x: str) -> str:
    return f"list_distinct([lower(trim(t, '.')) FOR t IN regexp_extract_all({strip(x)}, '[\\p{{L}}\\p{{N}}_.]+')])"


def numbers(x: str) -> str:
    return f"list_distinct([replace(t, ',', '.') FOR t IN regexp_extract_all({strip(x)}, '\\d+(?:[.,]\\d+)?')])"


def norm(x: str) -> str:
    return f"lower(trim(regexp_replace({strip(x)}, '{SPACE}', ' ', 'g')))"


def date_forms(d: str) -> str:
    y, m, n = f"{d}[1:4]", f"{d}[6:7]", f"{d}[9:10]"
    month, day = f"({MONTHS})[CAST({m} AS INT)]", f"CAST(CAST({n} AS INT) AS VARCHAR)"
    return f"[{d}, {n} || '.' || {m} || '.' || {y}, {day} || '.' || CAST(CAST({m} AS INT) AS VARCHAR) || '.' || {y}, {day} || ' ' || {month} || ' ' || {y}, {month} || ' ' || {day} || ', ' || {y}, {day} || '. ' || {month} || ' ' || {y}, {n} || '/' || {m} || '/' || {y}]"


ORCIDS = f"orcids AS (SELECT DISTINCT c.agent_id, c.record_id, regexp_extract(coalesce(u.x.nameidentifier, ''), '{P.ORCID}') AS orcid FROM creators c, unnest(c.nameidentifiers) AS u(x)), owned AS (SELECT o.agent_id, o.orcid, l.doc_id FROM orcids o JOIN last l USING (record_id) WHERE o.orcid <> '')"
IDENTIFIERS = f"ids AS (SELECT DISTINCT doc_id, unnest(list_concat([upper(x) FOR x IN regexp_extract_all(text, '{P.ORCID}')], [lower(regexp_replace(x, '[.,;:)\\]}}>]+$', '')) FOR x IN regexp_extract_all(text, '{DOI}')])) AS identifier FROM docs)"
DESCRIPTIONS = "texts AS (SELECT d.description_id, d.description, l.doc_id FROM (SELECT DISTINCT description_id, record_id, description FROM descriptions WHERE description IS NOT NULL) d JOIN last l USING (record_id))"

_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(lower(trim(coalesce(contributortype, ''))), '{p}') THEN '{k}'" for p, k in P.ROLE_TYPES) + " ELSE 'Other' END"
_NFIRST = "(SELECT DISTINCT title_id, record_id, title FROM titles)"
_UNKNOWN_IDS = f"SELECT o.agent_id, o.orcid FROM owned o JOIN docs d USING (doc_id) WHERE NOT contains({norm0('d.text')}, {norm0('o.orcid')})"
_NAMES = "families AS (SELECT c.agent_id, l.doc_id, trim(coalesce(nullif(c.familyname, ''), split_part(coalesce(c.name, ''), ',', 1))) AS family FROM (SELECT DISTINCT agent_id, record_id, name, familyname FROM creators) c JOIN last l USING (record_id))"
_UNKNOWN_NAMES = f"SELECT f.agent_id, f.family FROM families f JOIN docs d USING (doc_id) WHERE f.family <> '' AND NOT contains({norm0('d.text')}, {norm0('f.family')})"
_NEW = f"SELECT description_id, doc_id, array_to_string(list_sort([n FOR n IN {numbers('t.description')} IF NOT list_contains({numbers('d.text')}, n)]), ', ') AS value FROM texts t JOIN docs d USING (doc_id)"
_DUP = f"titled AS (SELECT t.title_id, l.doc_id, lower(trim(coalesce(t.title, ''))) AS value FROM {_NFIRST} t JOIN last l USING (record_id)), firsts AS (SELECT doc_id, value, min(title_id) AS first_idx FROM titled GROUP BY ALL), dups AS (SELECT t.doc_id, t.title_id, t.value, f.first_idx FROM titled t JOIN firsts f USING (doc_id, value) WHERE t.title_id > f.first_idx)"

_BOXES = """boxes AS (SELECT l_orderkey AS doc_id, 'w' || l_partkey || CASE WHEN l_partkey % 5 = 0 THEN '(cid:7)' ELSE '' END AS text, CAST((l_linenumber * 53) % 300 AS DOUBLE) AS x0,
 CAST((l_linenumber * 53) % 300 AS DOUBLE) + 20 AS x1, (l_linenumber % 3) * 14 + CASE WHEN l_partkey % 8 = 0 THEN -3.0 WHEN l_partkey % 4 = 0 THEN 6.0 ELSE 0.0 END AS top,
 CASE WHEN l_partkey % 4 = 0 THEN 6.0 ELSE 10.0 END AS size, CASE WHEN l_partkey % 9 = 0 THEN 'field' ELSE 'text' END AS kind, l_linenumber % 3 AS line_no, l_linenumber AS n FROM lineitem)"""


def all_sql() -> dict[str, str]:
    from lithoflow.plans import record_sql

    return record_sql.all_sql() | {
        "copy_ratio": f"WITH {DOCS}, w AS (SELECT doc_id, {words('text')} AS w FROM docs), r AS (SELECT DISTINCT doc_id, unnest({shingles('w')}) AS run FROM w), iw AS (SELECT item_id, {words('coalesce(text, chr(32))')} AS w FROM eval_items), ir AS (SELECT DISTINCT item_id, unnest({shingles('w')}) AS run FROM iw), n AS (SELECT item_id, count(*) AS total FROM ir GROUP BY 1) SELECT doc_id, item_id, count(*) / any_value(total) AS ratio FROM r JOIN ir USING (run) JOIN n USING (item_id) GROUP BY ALL HAVING count(*) / any_value(total) >= 0.8",
        "copied_descriptions": f"WITH {LAST}, {DOCS}, {DESCRIPTIONS}, p AS (SELECT doc_id, text, {norm0(strip('text'))} AS haystack, {shingles(words('text'))} AS s FROM docs), q AS (SELECT t.description_id, p.*, {norm0(strip('t.description'))} AS key, {shingles(words('t.description'))} AS mine, t.description FROM texts t JOIN p USING (doc_id)) SELECT description_id, key = '' OR contains(haystack, key) OR (len(mine) > 0 AND len(list_intersect(mine, s)) / len(mine) >= 0.8) OR (len(mine) = 0 AND contains({norm0('text')}, {norm0('description')})) AS copied FROM q",
        "keyword_filter": f"WITH {LAST}, {DOCS}, s AS (SELECT DISTINCT subject_id, record_id, subject FROM subjects WHERE trim(subject) <> ''), p AS (SELECT doc_id, {tokens('text')} AS t FROM docs) SELECT subject_id, len([w FOR w IN {tokens('trim(subject)')} IF (regexp_matches(w, '\\p{{Nd}}') OR length(w) >= 4) AND NOT list_contains(p.t, w)]) = 0 AS in_source FROM s JOIN last USING (record_id) JOIN p USING (doc_id)",
        "norm_fingerprint": f"WITH {DOCS} SELECT doc_id, sha256({norm0('text')}) AS sha, length({norm0('text')}) AS n_norm FROM docs",
        "number_set_str": f"WITH {DOCS} SELECT doc_id, unnest({numbers('text')}) AS number FROM docs",
        "number_set_num": f"WITH d AS (SELECT DISTINCT description_id, description FROM descriptions WHERE description IS NOT NULL) SELECT DISTINCT description_id, CAST(unnest({numbers(norm('description'))}) AS DOUBLE) AS number FROM d",
        "new_numbers": f"WITH {LAST}, {DOCS}, {DESCRIPTIONS}, n AS ({_NEW}) SELECT description_id, value FROM n WHERE value <> ''",
        "doc_identifiers": f"WITH {DOCS}, {IDENTIFIERS} SELECT * FROM ids",
        "verified_orcids": f"WITH {LAST}, {DOCS} SELECT agent_id, CAST(len([x FOR x IN coalesce(nameidentifiers, []) IF regexp_extract(coalesce(x.nameidentifier, ''), '{P.ORCID}') <> '' AND contains({norm0('d.text')}, {norm0(f'regexp_extract(coalesce(x.nameidentifier, chr(32)), {chr(39)}{P.ORCID}{chr(39)})')})]) AS INT) AS n_verified FROM creators JOIN last USING (record_id) JOIN docs d USING (doc_id)",
        "date_in_source": f"WITH {DOCS}, r AS (SELECT delivery_id, doc_id, strftime(created_at, '%Y-%m-%d') AS d FROM records WHERE created_at IS NOT NULL), n AS (SELECT doc_id, {norm0('text')} AS n FROM docs) SELECT delivery_id, list_bool_or([contains(n, {norm0('f')}) FOR f IN {date_forms('d')}]) AS in_source FROM r JOIN n USING (doc_id)",
        "code_from_title": "WITH t AS (SELECT DISTINCT title_id, title FROM titles), f AS (SELECT title_id, trim(regexp_extract(coalesce(title, ''), '\\(([^()]{2,40})\\)\\s*\\.?\\s*$', 1)) AS code FROM t) SELECT * FROM f WHERE code <> '' AND len(regexp_split_to_array(code, '\\s+')) <= 2 AND regexp_matches(code, '[\\p{Nd}_]|[A-Z]{2,}')",
        "prompt_truncation": f"WITH {DOCS}, p AS (SELECT doc_id, 'Read this:' || chr(10) || text[1:30000] || chr(10) || 'Answer in JSON.' AS p FROM docs) SELECT doc_id, length(p) AS n_prompt, sha256(p) AS sha FROM p",
        "md_table": "SELECT l_orderkey, '| line | part | flags |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_returnflag || '\\|' || l_linestatus || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag || '|' || l_linestatus) AS md FROM lineitem GROUP BY 1",
        "input_filter": "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '~$' WHEN doc_id % 11 = 0 THEN '.' ELSE '' END || 'doc' || doc_id || '.' || CASE WHEN doc_id % 5 = 0 THEN 'ODT' ELSE file_format END AS name, lower(CASE WHEN doc_id % 5 = 0 THEN 'ODT' ELSE file_format END) AS s FROM documents) SELECT doc_id, NOT starts_with(name, '~$') AND NOT starts_with(name, '.') AND s IN ('docx', 'pdf', 'doc', 'odt', 'rtf', 'pages') AS is_input, CASE WHEN s IN ('docx', 'pdf') THEN s END AS format, s NOT IN ('docx', 'pdf') AS fatal FROM d",
        "safe_name": "SELECT DISTINCT title_id, trim(regexp_replace(title, '[^\\p{L}\\p{N} _.\\-]', '', 'g'))[1:20] AS name FROM titles WHERE title IS NOT NULL",
        "json_walk": "SELECT event_id, u.k AS path, json_extract_string(props, '$.' || u.k) AS value FROM events, unnest(json_keys(props)) AS u(k)",
        "contributor_type": f"SELECT agent_id, {_ROLE} AS kind FROM contributors",
        "sub_super_plain": "SELECT DISTINCT title_id, translate(title, '0123456789', '₀₁₂₃₄₅₆₇₈₉') AS plain FROM titles WHERE title IS NOT NULL",
        "iso_dates": f"WITH {DOCS}, r AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\d{{1,2}}\\.? (?:{'|'.join(P.MONTH_NAMES)}) \\d{{4}}|(?:{'|'.join(P.MONTH_NAMES)}) \\d{{1,2}}, \\d{{4}}|\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}')) AS raw FROM docs), p AS (SELECT *, CASE WHEN regexp_full_match(raw, '[\\d.]+') THEN raw ELSE regexp_replace(regexp_replace(raw, '^([A-Za-z]+) (\\d+), (\\d+)$', '\\2 \\1 \\3'), '[.]', '') END AS v FROM r) SELECT doc_id, raw, strftime(coalesce(try_strptime(v, '%d.%m.%Y'), try_strptime(v, '%d %B %Y')), '%Y-%m-%d') AS iso FROM p",
        "bare_doi": "SELECT delivery_id, trim(coalesce(doi, '')) AS bare FROM records",
        "publication_year": f"WITH {DOCS}, t AS (SELECT doc_id, text || CASE WHEN doc_id % 4 = 0 THEN chr(10) || 'Additional information: published in print, 2019' ELSE '' END AS t FROM docs) SELECT doc_id, coalesce(nullif(regexp_extract(CASE WHEN instr(t, 'Additional information') > 0 THEN t[instr(t, 'Additional information') + 22:] ELSE '' END, '(?i)publi[\\p{{L}}\\p{{N}}_]*[^.\\n]{{0,80}}?\\b((?:19|20)\\d{{2}})\\b', 1), ''), '2026') AS year FROM t",
        "format_time": "WITH o AS (SELECT o_orderkey, o_custkey * 7 AS s FROM orders WHERE o_orderkey IS NOT NULL) SELECT o_orderkey, CASE WHEN s < 60 THEN printf('%.2fs', CAST(s AS DOUBLE)) WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s // 60 % 60) || 'm' END AS t FROM o",
        "list_labels": "SELECT s_suppkey, repeat('M', s_suppkey // 1000) || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][s_suppkey // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][s_suppkey // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][s_suppkey % 10 + 1] AS roman, chr(CAST(97 + (s_suppkey - 1) % 26 AS INT)) AS letter FROM supplier WHERE s_suppkey >= 1",
        "first_wins_unique": "WITH s AS (SELECT DISTINCT subject_id, record_id, coalesce(subject, '') AS v FROM subjects), r AS (SELECT *, row_number() OVER (PARTITION BY record_id, lower(trim(v)) ORDER BY subject_id, v) AS k FROM s) SELECT record_id, string_agg(v, '|' ORDER BY subject_id, v) AS kept FROM r WHERE k = 1 GROUP BY 1",
        "stable_date_sort": "WITH o AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY ALL) SELECT o_custkey, string_agg(d || ' ' || p, ';' ORDER BY d, k) AS dates FROM o GROUP BY 1",
        "records_gathered": f"WITH {LAST}, t AS (SELECT record_id, count(*) AS n FROM (SELECT DISTINCT * FROM titles) GROUP BY 1), c AS (SELECT record_id, count(*) AS n FROM (SELECT DISTINCT record_id, agent_id FROM creators) GROUP BY 1), s AS (SELECT record_id, count(*) AS n FROM (SELECT DISTINCT record_id, subject_id FROM subjects) GROUP BY 1), d AS (SELECT record_id, count(*) AS n FROM (SELECT DISTINCT record_id, description_id FROM descriptions) GROUP BY 1) SELECT l.record_id, l.doc_id, CAST(coalesce(t.n, 0) AS INT) AS n_titles, CAST(coalesce(c.n, 0) AS INT) AS n_creators, CAST(coalesce(s.n, 0) AS INT) AS n_subjects, CAST(coalesce(d.n, 0) AS INT) AS n_descriptions FROM last l LEFT JOIN t USING (record_id) LEFT JOIN c USING (record_id) LEFT JOIN s USING (record_id) LEFT JOIN d USING (record_id)",
        "lookup_join": "WITH k AS (SELECT text, min(ror) AS ror FROM (SELECT unnest(list_concat([label], coalesce(aliases, []))) AS text, ror FROM organisations) GROUP BY 1) SELECT affiliation_id, coalesce(CASE WHEN coalesce(affiliationidentifier, '') = '' AND coalesce(name, '') <> '' AND k.ror IS NOT NULL THEN k.ror ELSE affiliationidentifier END, '') AS identifier, CASE WHEN coalesce(affiliationidentifier, '') <> '' THEN 'kept' WHEN coalesce(name, '') = '' THEN 'empty' WHEN k.ror IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS status FROM affiliations LEFT JOIN k ON k.text = affiliations.name",
        "late_windows": "SELECT strftime(received_at, '%Y-%m-%d') AS day, coalesce(source, '') AS source, count(*) AS n FROM documents WHERE received_at IS NOT NULL GROUP BY ALL",
        "style_examples": "WITH e(pos, block, src) AS (VALUES (0, 'Title: Basalt core' || chr(10) || 'Abstract: A core.', ['desk-01']), (1, 'Title: Gypsum rod' || chr(10) || 'Abstract: A rod.', []), (2, 'Title: Peat disc' || chr(10) || 'Abstract: A disc.', ['desk-02', 'desk-03']), (3, 'Title: Zirconia foil' || chr(10) || 'Abstract: A foil.', []), (4, 'Title: Titania wafer' || chr(10) || 'Abstract: A wafer.', []), (5, 'Title: Olivine slab' || chr(10) || 'Abstract: A slab.', ['desk-01'])), d AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), r AS (SELECT source, pos, block, row_number() OVER (PARTITION BY source ORDER BY pos) AS k FROM d, e WHERE NOT list_contains(src, source)) SELECT source, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS block FROM r WHERE k <= 4 GROUP BY 1",
        "words_outside_tables": f"WITH {_BOXES} SELECT doc_id, n, replace(text, '(cid:7)', '') AS text FROM boxes WHERE NOT ((x0 + x1) / 2 BETWEEN 100 AND 220 AND top + size / 2 BETWEEN 0 AND 20)",
        "script_words": f"WITH {_BOXES}, b AS (SELECT *, count(*) FILTER (kind = 'text') OVER w AS nt, quantile_cont(size, 0.5) FILTER (kind = 'text') OVER w AS base FROM boxes WINDOW w AS (PARTITION BY doc_id, line_no)), f AS (SELECT *, quantile_cont(top + size, 0.5) FILTER (kind = 'text' AND size >= 0.85 * base) OVER (PARTITION BY doc_id, line_no) AS floor FROM b), s AS (SELECT doc_id, n, CASE WHEN top + size < floor - 0.15 * base THEN 'sup' WHEN top + size > floor + 0.15 * base THEN 'sub' END AS kind FROM f WHERE kind = 'text' AND nt >= 2 AND size < 0.85 * base) SELECT * FROM s WHERE kind IS NOT NULL",
        "rendered_lines": f"WITH {_BOXES}, g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY x0, n, text) AS k FROM boxes), p AS (SELECT *, lag(x1) OVER w AS px, lag(size) OVER w AS ps, lag(kind) OVER w AS pk FROM g WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY k)) SELECT doc_id, line_no, string_agg(CASE WHEN px IS NOT NULL AND (x0 - px > 0.15 * least(ps, size) OR kind = 'field' OR pk = 'field') THEN ' ' ELSE '' END || text, '' ORDER BY k) AS text FROM p GROUP BY 1, 2",
        "page_quality": "WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, CAST(l_quantity AS INT) / 100.0 > 0.3 AS bad, l_partkey % 40 < 20 AS short FROM lineitem) SELECT doc_id, coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (bad), '') AS unreadable, coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (NOT bad AND short), '') AS empty, bool_and(bad OR short) AS fatal FROM p GROUP BY 1",
        "links_section": f"WITH {LAST}, {DOCS}, {ORCIDS}, u AS (SELECT doc_id, 'https://orcid.org/' || orcid AS uri, min(agent_id) AS k FROM owned GROUP BY ALL), h AS (SELECT u.*, CASE WHEN k % 2 = 0 THEN '- author → ' ELSE '- ' END || uri AS line FROM u JOIN docs d USING (doc_id) WHERE NOT contains({norm0('d.text')}, {norm0('u.uri')})) SELECT doc_id, '## Links in the document' || chr(10) || string_agg(line, chr(10) ORDER BY k, line) AS section FROM h GROUP BY 1",
        "lost_identifiers": f"WITH {DOCS}, {IDENTIFIERS}, t AS (SELECT doc_id, {norm0(strip('text[1:length(text) // 2]'))} AS t FROM docs) SELECT doc_id, string_agg(identifier, ',' ORDER BY identifier) AS lost FROM ids JOIN t USING (doc_id) WHERE NOT contains(t, {norm0('identifier')}) GROUP BY 1",
    }
