"""The record queries in SQL, for the registered tables; written independently of the operators."""

from __future__ import annotations

from lithoflow import policy as P
from lithoflow.plans import sql as S

NESTED = f"""{S.LAST}, {S.DOCS},
 lastr AS (SELECT record_id, doc_id, doi, publisher, schemaversion, publicationyear FROM records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY received_at DESC NULLS LAST, delivery_id DESC) = 1),
 rel AS (SELECT record_id, lead(doi) OVER (PARTITION BY doc_id ORDER BY record_id) AS next_doi FROM lastr),
 days AS (SELECT record_id, strftime(created_at, '%Y-%m-%d') AS d, row_number() OVER (PARTITION BY record_id ORDER BY strftime(created_at, '%Y-%m-%d')) - 1 AS i FROM records WHERE created_at IS NOT NULL),
 agents AS (SELECT DISTINCT record_id, agent_id, name, givenname, familyname, nameidentifiers, false AS curator FROM creators UNION ALL SELECT DISTINCT record_id, agent_id, name, givenname, familyname, nameidentifiers, ({S._ROLE}) = 'DataCurator' FROM contributors),
 places AS (SELECT DISTINCT affiliation_id, agent_id, name, affiliationidentifier, affiliationidentifierscheme, schemeuri FROM affiliations),
 ts AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY title_id) - 1 AS i FROM (SELECT DISTINCT title_id, record_id, title, lang FROM titles)),
 ds AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY description_id) - 1 AS i FROM (SELECT DISTINCT description_id, record_id, description, lang FROM descriptions)),
 ss AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY subject_id) - 1 AS i FROM (SELECT DISTINCT subject_id, record_id, subject, lang FROM subjects))"""

LEAVES = """leaves AS (SELECT record_id, false AS curator, doi AS v FROM lastr UNION ALL SELECT record_id, false, publisher.name FROM lastr WHERE false UNION ALL SELECT record_id, false, publicationyear FROM lastr UNION ALL SELECT record_id, false, schemaversion FROM lastr
 UNION ALL SELECT record_id, curator, unnest([name, givenname, familyname]) FROM agents
 UNION ALL SELECT a.record_id, a.curator, unnest([u.x.nameidentifier, u.x.nameidentifierscheme, u.x.schemeuri]) FROM agents a, unnest(a.nameidentifiers) AS u(x)
 UNION ALL SELECT a.record_id, a.curator, unnest([p.name, p.affiliationidentifier, p.affiliationidentifierscheme, p.schemeuri]) FROM places p JOIN agents a USING (agent_id)
 UNION ALL SELECT record_id, false, unnest([title, lang]) FROM ts UNION ALL SELECT record_id, false, unnest([description, lang]) FROM ds UNION ALL SELECT record_id, false, unnest([subject, lang]) FROM ss
 UNION ALL SELECT record_id, false, d FROM days UNION ALL SELECT record_id, false, next_doi FROM rel)"""

NORMS = f"norms AS (SELECT doc_id, text, {S.norm0('text')} AS n, {S.numbers('text')} AS numbers FROM docs)"
IDS = f"""hits AS (SELECT record_id, 'orcid' AS kind, unnest(regexp_extract_all(v, '{P.ORCID}')) AS value FROM leaves WHERE NOT curator UNION ALL SELECT record_id, 'doi', unnest(regexp_extract_all(v, '{S.DOI}')) FROM leaves WHERE NOT curator UNION ALL SELECT record_id, 'ror', unnest(regexp_extract_all(v, '{P.ROR}', 1)) FROM leaves WHERE NOT curator),
 rule1 AS (SELECT h.record_id, l.doc_id, h.kind, h.value FROM hits h JOIN lastr l USING (record_id) JOIN norms d USING (doc_id) WHERE NOT contains(d.n, {S.norm0('h.value')}))"""
NAMES = f"""fams AS (SELECT record_id, trim(coalesce(nullif(familyname, ''), split_part(coalesce(name, ''), ',', 1))) AS value FROM agents WHERE NOT curator),
 rule2 AS (SELECT f.record_id, l.doc_id, f.value FROM fams f JOIN lastr l USING (record_id) JOIN norms d USING (doc_id) WHERE f.value <> '' AND NOT contains(d.n, {S.norm0('f.value')}))"""
FIXED = f"""rule3 AS (SELECT record_id, doc_id, 'schemaVersion' AS path, coalesce(schemaversion, '') AS value FROM lastr JOIN docs USING (doc_id) WHERE schemaversion IS DISTINCT FROM '{P.Policy().schema_version}' UNION ALL SELECT record_id, doc_id, 'publisher.name', coalesce(publisher.name, '') FROM lastr JOIN docs USING (doc_id) WHERE publisher.name IS DISTINCT FROM '{P.Policy().publisher['name']}')"""
DATES = f"""rule4 AS (SELECT y.record_id, l.doc_id, 'dates[' || y.i || '].date' AS path, y.d AS value FROM days y JOIN lastr l USING (record_id) JOIN norms d USING (doc_id) WHERE NOT list_bool_or([contains(d.n, {S.norm0('f')}) FOR f IN {S.date_forms('y.d')}])),
 rule6 AS (SELECT y.record_id, any_value(l.doc_id) AS doc_id, string_agg(y.d, ', ' ORDER BY y.d) AS value FROM days y JOIN lastr l USING (record_id) JOIN docs USING (doc_id) GROUP BY 1 HAVING count(*) > 1)"""
NUMBERS = f"""told AS (SELECT record_id, 'titles[0].title' AS path, coalesce(title, '') AS t FROM ts WHERE i = 0 UNION ALL SELECT record_id, 'descriptions[' || i || '].description', coalesce(description, '') FROM ds),
 rule5 AS (SELECT * FROM (SELECT t.record_id, l.doc_id, t.path, array_to_string(list_sort([x FOR x IN {S.numbers('t.t')} IF NOT list_contains(d.numbers, x)]), ', ') AS value FROM told t JOIN lastr l USING (record_id) JOIN norms d USING (doc_id)) WHERE value <> '')"""
MISSING = f"""whole AS (SELECT record_id, {S.norm0("string_agg(v, ' ')")} AS w FROM leaves GROUP BY 1),
 found AS (SELECT DISTINCT doc_id, 'missing-orcid' AS kind, regexp_replace(unnest(regexp_extract_all(text, '{P.ORCID}')), '[.,;:)]+$', '') AS value FROM docs UNION SELECT DISTINCT doc_id, 'missing-doi', regexp_replace(unnest(regexp_extract_all(text, '{S.DOI}')), '[.,;:)]+$', '') FROM docs),
 rule7 AS (SELECT l.record_id, l.doc_id, f.kind, f.value FROM lastr l JOIN found f USING (doc_id) LEFT JOIN whole w USING (record_id) WHERE NOT contains(coalesce(w.w, ''), {S.norm0('f.value')}))"""
TITLES = "firsts AS (SELECT l.doc_id, l.record_id, lower(trim(coalesce(t.title, ''))) AS k FROM lastr l LEFT JOIN (SELECT * FROM ts WHERE i = 0) t USING (record_id)), rule0 AS (SELECT doc_id, record_id FROM firsts QUALIFY record_id > min(record_id) OVER (PARTITION BY doc_id, k))"
ALL = f"{NESTED}, {LEAVES}, {NORMS}, {IDS}, {NAMES}, {FIXED}, {DATES}, {NUMBERS}, {MISSING}, {TITLES}"
EVERY = "every AS (SELECT doc_id, 'error' AS severity, kind FROM rule1 UNION ALL SELECT doc_id, 'error', 'creator-name' FROM rule2 UNION ALL SELECT doc_id, 'warning', 'fixed-field' FROM rule3 UNION ALL SELECT doc_id, 'warning', 'date' FROM rule4 UNION ALL SELECT doc_id, 'warning', 'number' FROM rule5 UNION ALL SELECT doc_id, 'warning', 'dates' FROM rule6 UNION ALL SELECT doc_id, 'warning', kind FROM rule7 UNION ALL SELECT doc_id, 'warning', 'duplicate-title' FROM rule0)"

_COPIED = f"(key = '' OR contains(haystack, key) OR (len(mine) > 0 AND len(list_intersect(mine, s)) / len(mine) >= {P.LEAST_COPIED}) OR (len(mine) = 0 AND contains(n0, own)))"


def copied(of: str, value: str) -> str:
    """A CTE body: rows of ``of`` with ``ok``, whether ``value`` is copied from the row's document."""
    return f"SELECT *, {_COPIED} AS ok FROM (SELECT o.*, p.* EXCLUDE (doc_id), {S.norm0(S.strip(f'coalesce({value}, chr(0))')).replace('chr(0)', chr(39) * 2)} AS key, {S.shingles(S.words(f'coalesce({value}, chr(0))')).replace('chr(0)', chr(39) * 2)} AS mine, {S.norm0(f'coalesce({value}, chr(0))').replace('chr(0)', chr(39) * 2)} AS own FROM {of} o JOIN prep p USING (doc_id))"


PREP = f"prep AS (SELECT doc_id, {S.norm0(S.strip('text'))} AS haystack, {S.shingles(S.words('text'))} AS s, {S.norm0('text')} AS n0, {S.tokens('text')} AS toks FROM docs)"
IN_SOURCE = f"len([w FOR w IN {S.tokens('value')} IF (regexp_matches(w, '\\p{{Nd}}') OR length(w) >= 4) AND NOT list_contains(toks, w)]) = 0"
SAMPLES = f"""{NESTED}, {PREP},
 samples AS (SELECT l.doc_id, l.record_id, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.record_id) - 1 AS sample_no, t.title, d.description FROM lastr l JOIN docs USING (doc_id) LEFT JOIN (SELECT * FROM ts WHERE i = 0) t USING (record_id) LEFT JOIN (SELECT * FROM ds WHERE i = 0) d USING (record_id)),
 vt AS ({copied('(SELECT doc_id, record_id, title AS value FROM samples)', 'value')}), vd AS ({copied('(SELECT doc_id, record_id, description AS value FROM samples)', 'value')}),
 vf AS (SELECT record_id, ok OR {IN_SOURCE} AS ok FROM ({copied("(SELECT doc_id, record_id, ' ' || coalesce(title, '') AS value FROM samples)", 'value')})),
 vs AS (SELECT record_id, count(*) FILTER (ok OR {IN_SOURCE}) AS n FROM ({copied("(SELECT l.doc_id, l.record_id, trim(subject) AS value FROM ss JOIN lastr l USING (record_id) WHERE trim(coalesce(subject, '')) <> '')", 'value')}) GROUP BY 1)"""
ROLES = "rs AS (SELECT f.doc_id, c.agent_id, c.contributortype AS role, coalesce(nullif(c.familyname, ''), split_part(coalesce(c.name, ''), ',', 1)) AS family, docs.text FROM contributors c JOIN f USING (record_id) JOIN docs USING (doc_id) WHERE trim(coalesce(c.contributortype, '')) <> ''), {near}, n AS (SELECT doc_id, count(*) FILTER (near) AS n FROM nr GROUP BY 1)"
_CODE = "trim(regexp_extract(coalesce(v, ''), '\\(([^()]{2,40})\\)\\s*\\.?\\s*$', 1))"

_TITLE = P.ACADEMIC_TITLE.replace(r"(?=\s|$)", "(\\s|$)").replace("(?i)\\b", "(?i)(^|[^\\p{L}\\p{N}_])")


_KEYS = ("creators", "relatedIdentifiers", "titles", "doi", "contributors", "types", "publisher", "descriptions", "subjects", "dates")
_WRAPS = ("records", "data", "content", "items", "attributes", "record")


def _present(j: str, keys: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"json_exists({j}, '$.{k}')" for k in keys) + ")"


def _unwrapped(j: str, keys: tuple[str, ...]) -> str:
    """One step into an envelope or into JSON text, else the value itself."""
    steps = " ".join(f"WHEN json_type({j}) = 'OBJECT' AND json_exists({j}, '$.{k}') THEN json_extract({j}, '$.{k}')" for k in keys)
    return f"CASE WHEN json_type({j}) = 'VARCHAR' THEN TRY_CAST(json_extract_string({j}, '$') AS JSON) WHEN json_type({j}) = 'OBJECT' AND {_present(j, _KEYS)} THEN {j} {steps} ELSE {j} END"


def _items(j: str) -> str:
    return f"CASE WHEN json_type({j}) = 'ARRAY' THEN CAST({j} AS JSON[]) WHEN {j} IS NULL THEN [] ELSE [{j}] END"


def _elements(source: str, field: str, parent: str, key: str) -> str:
    """Rows (raw_id, record_pos, parent_pos, item_pos, x, value) of the elements of a list field of ``source``'s x."""
    value = f"CASE WHEN json_type(x) = 'OBJECT' THEN CASE WHEN json_type(x, '$.{key}') NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(x, '$.{key}') END WHEN json_type(x) <> 'ARRAY' THEN json_extract_string(x, '$') END"
    return f"SELECT raw_id, record_pos, parent_pos, item_pos, x, {value} AS value FROM (SELECT raw_id, record_pos, {parent} AS parent_pos, item_pos, l[item_pos + 1] AS x FROM (SELECT raw_id, record_pos, {'item_pos AS holder' if parent != '-1' else '-1 AS holder'}, l, unnest(range(len(l))) AS item_pos FROM (SELECT *, {_items(f"json_extract(x, '$.{field}')")} AS l FROM {source} WHERE json_type(x) = 'OBJECT')))"


SHRED = f"""p0 AS (SELECT DISTINCT raw_id, TRY_CAST(payload AS JSON) AS j FROM raw_records WHERE trim(coalesce(payload, '')) <> ''), p1 AS (SELECT raw_id, {_unwrapped('j', _WRAPS)} AS j FROM p0 WHERE j IS NOT NULL), p2 AS (SELECT raw_id, {_unwrapped('j', _WRAPS)} AS j FROM p1), p3 AS (SELECT raw_id, {_unwrapped('j', _WRAPS)} AS j FROM p2), p4 AS (SELECT raw_id, {_unwrapped('j', _WRAPS)} AS j FROM p3),
 r0 AS (SELECT raw_id, l, unnest(range(len(l))) AS record_pos FROM (SELECT raw_id, {_items('j')} AS l FROM p4 WHERE json_type(j) IN ('ARRAY', 'OBJECT'))), r1 AS (SELECT raw_id, record_pos, l[record_pos + 1] AS x FROM r0), r2 AS (SELECT raw_id, record_pos, {_unwrapped('x', _WRAPS[4:])} AS x FROM r1), recs AS (SELECT raw_id, record_pos, {_unwrapped('x', _WRAPS[4:])} AS x FROM r2),
 creators_ AS ({_elements('recs', 'creators', '-1', 'name')}), related_ AS ({_elements('recs', 'relatedIdentifiers', '-1', 'relatedIdentifier')}), places_ AS ({_elements('creators_', 'affiliation', 'holder', 'name')}), ids_ AS ({_elements('creators_', 'nameIdentifiers', 'holder', 'nameIdentifier')})"""
_FILLED = f"regexp_matches(coalesce(value, ''), '[^{S.SPACE[1:-2]}]')"

WIDE = "".join(chr(c) for c in range(0xFF21, 0xFF5B)), "".join(chr(c - 0xFEE0) for c in range(0xFF21, 0xFF5B))


def spelt(x: str) -> str:
    """Ligatures as their letters."""
    for sign, letters in P.LIGATURES.items():
        x = f"replace({x}, '{sign}', '{letters}')"
    return x


def upper(x: str) -> str:
    return f"upper(replace({spelt(x)}, 'ß', 'ss'))"


def name_key(x: str) -> str:
    return f"regexp_replace(lower(strip_accents(translate({spelt(x)}, '{WIDE[0]}', '{WIDE[1]}'))), '[^a-z]', '', 'g')"


def recased(registered: str, written: str) -> str:
    runs = f"regexp_extract_all(lower({registered}), '\\p{{L}}+|[^\\p{{L}}]+')"
    return f"CASE WHEN coalesce({written}, '') <> '' AND {name_key(written)} = {name_key(registered)} AND NOT (upper({written}) = {written} AND lower({written}) <> {written}) THEN {written} ELSE array_to_string([upper(z[1]) || z[2:] FOR z IN {runs}], '') END"


def all_sql() -> dict[str, str]:
    of_record = lambda rule, *columns: f"WITH {ALL} SELECT record_id, {', '.join(columns)}, count(*) AS n FROM {rule} GROUP BY ALL"
    near = "list_bool_or([contains(t[greatest(q - 80, 0) + 1:q + length(nm) + 80], rl) FOR q IN starts])"
    starts = "CASE WHEN nm = '' THEN [] ELSE [CAST(list_sum([length(z) FOR z IN parts[1:k]]) + (k - 1) * length(nm) AS BIGINT) FOR k IN range(1, len(parts))] END"
    near_cte = lambda of: f"nn AS (SELECT *, string_split(t, nm) AS parts FROM (SELECT *, lower(trim(family)) AS nm, lower(trim(role)) AS rl, lower(regexp_replace({S.strip('text')}, '{S.SPACE}', ' ', 'g')) AS t FROM {of})), np AS (SELECT *, {starts} AS starts FROM nn), nr AS (SELECT *, coalesce(rl <> '' AND {near}, false) AS near FROM np)"
    return {
        "unknown_identifiers": of_record("rule1", "kind", "value"),
        "unknown_names": of_record("rule2", "value"),
        "fixed_fields": of_record("rule3", "path", "value"),
        "unknown_dates": of_record("rule4", "path", "value"),
        "unknown_numbers": of_record("rule5", "path", "value"),
        "created_dates": of_record("rule6", "value"),
        "missing_identifiers": of_record("rule7", "kind", "value"),
        "duplicate_titles": f"WITH {S.LAST}, t AS (SELECT d.source, t.title_id, lower(trim(coalesce(t.title, ''))) AS value FROM {S._NFIRST} t JOIN last l USING (record_id) JOIN documents d USING (doc_id) WHERE d.source IS NOT NULL) SELECT source, title_id, value, min(title_id) OVER (PARTITION BY source, value) AS first_idx FROM t QUALIFY title_id > first_idx",
        "findings_union": f"WITH {ALL}, {EVERY} SELECT doc_id, severity, kind, count(*) AS n FROM every GROUP BY ALL",
        "findings_summary": f"WITH {ALL}, {EVERY} SELECT doc_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM every GROUP BY 1",
        "verified_samples": f"WITH {SAMPLES} SELECT s.doc_id, CAST(s.sample_no AS INT) AS sample_no, coalesce(vt.value, '') <> '' AND vt.ok AS title, coalesce(vd.value, '') <> '' AND vd.ok AS description, CAST(CASE WHEN vf.ok THEN 1 ELSE 0 END AS INT) AS n_facts, CAST(coalesce(vs.n, 0) AS INT) AS n_subjects, CASE WHEN len(regexp_split_to_array(c.code, '\\s+')) <= 2 AND regexp_matches(c.code, '[\\p{{Nd}}_]|[A-Z]{{2,}}') THEN c.code ELSE '' END AS code FROM samples s JOIN vt USING (record_id) JOIN vd USING (record_id) JOIN vf USING (record_id) LEFT JOIN vs USING (record_id) JOIN (SELECT record_id, {_CODE} AS code FROM (SELECT record_id, CASE WHEN ok THEN value END AS v FROM vt)) c USING (record_id)",
        "verified_shared": f"WITH {NESTED}, {PREP}, f AS (SELECT doc_id, min(record_id) AS record_id FROM lastr JOIN docs USING (doc_id) GROUP BY 1), vp AS ({copied('(SELECT f.doc_id, d.description AS value FROM f LEFT JOIN (SELECT * FROM ds WHERE i = 0) d USING (record_id))', 'value')}), {ROLES.format(near=near_cte('rs'))} SELECT vp.doc_id, coalesce(vp.value, '') <> '' AND vp.ok AS preparation, CAST(coalesce(n.n, 0) AS INT) AS n_roles FROM vp LEFT JOIN n USING (doc_id)",
        "built_parts": f"""WITH {SAMPLES}, f AS (SELECT doc_id, min(record_id) AS record_id FROM lastr JOIN docs USING (doc_id) GROUP BY 1), {ROLES.format(near=near_cte('rs'))},
 people AS (SELECT f.doc_id, count(*) AS n FROM agents a JOIN f USING (record_id) GROUP BY 1), ks AS (SELECT record_id, count(DISTINCT lower(value)) FILTER (ok OR {IN_SOURCE}) AS n FROM ({copied("(SELECT l.doc_id, l.record_id, trim(subject) AS value FROM ss JOIN lastr l USING (record_id) WHERE trim(coalesce(subject, '')) <> '')", 'value')}) GROUP BY 1),
 dd AS (SELECT record_id, string_agg(DISTINCT d, ';' ORDER BY d) AS dates FROM days GROUP BY 1)
 SELECT s.doc_id, CAST(s.sample_no AS INT) AS sample_idx, CAST(coalesce(people.n, 0) AS INT) AS n_creators, CAST(coalesce(n.n, 0) AS INT) AS n_contributors, CAST(coalesce(ks.n, 0) AS INT) AS n_subjects, coalesce(dd.dates, '') AS dates, coalesce(rel.next_doi, '') AS related, coalesce(nullif(regexp_extract(CASE WHEN instr(d.text, 'Additional information') > 0 THEN d.text[instr(d.text, 'Additional information') + 22:] ELSE '' END, '(?i)publi[\\p{{L}}\\p{{N}}_]*[^.\\n]{{0,80}}?\\b((?:19|20)\\d{{2}})\\b', 1), ''), '2026') AS year
 FROM samples s JOIN docs d USING (doc_id) LEFT JOIN people USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN ks USING (record_id) LEFT JOIN dd USING (record_id) LEFT JOIN rel USING (record_id)""",
        "p3_found": f"WITH {SHRED} " + " UNION ALL ".join(f"SELECT raw_id, CAST(record_pos AS BIGINT) AS record_pos, '{kind}' AS kind, CAST(parent_pos AS BIGINT) AS parent_pos, CAST(item_pos AS BIGINT) AS item_pos FROM {t} WHERE {_FILLED}" for kind, t in (("creator", "creators_"), ("affiliation", "places_"), ("nameidentifier", "ids_"), ("relatedidentifier", "related_"))),
        "p3_affiliations": f"WITH {SHRED} SELECT raw_id, CAST(record_pos AS BIGINT) AS record_pos, CAST(parent_pos AS BIGINT) AS parent_pos, CAST(item_pos AS BIGINT) AS item_pos, value AS name, " + ", ".join(f"CASE WHEN json_type(x) = 'OBJECT' AND json_type(x, '$.{k}') NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(x, '$.{k}') END AS {k.lower()}" for k in ("affiliationIdentifier", "affiliationIdentifierScheme", "schemeURI")) + f" FROM places_ WHERE {_FILLED}",
        "recovered_orcids": f"""WITH {S.DOCS}, t AS (SELECT doc_id, text, regexp_replace({S.strip('text')}, '{S.SPACE}', ' ', 'g') AS plain FROM docs), nm AS (SELECT DISTINCT doc_id, plain, unnest(regexp_extract_all(text, '([A-Z][a-z]+) \\([A-Z][a-z]+, ORCID', 1)) AS name FROM t), ns AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY name) - 1 AS idx, lower(name) AS nm, string_split(lower(plain), lower(name)) AS parts FROM nm),
 st AS (SELECT doc_id, idx, nm, plain, unnest({starts}) AS s FROM ns), w AS (SELECT a.doc_id, a.idx, a.plain, a.s, a.s + length(a.nm) AS b, min(o.s) FILTER (o.s >= a.s + length(a.nm)) AS nxt FROM st a LEFT JOIN st o ON o.doc_id = a.doc_id AND o.nm <> a.nm GROUP BY ALL),
 c AS (SELECT doc_id, idx, s, regexp_extract(plain[b + 1:least(b + 80, coalesce(nxt, b + 80))], '{P.ORCID}') AS orcid FROM w) SELECT doc_id, CAST(idx AS INT) AS person_idx, arg_min(orcid, s) AS orcid FROM c WHERE orcid <> '' GROUP BY 1, 2""",
        "role_near_name": f"WITH {S.DOCS}, r AS (SELECT doc_id, text, regexp_extract(text, '[A-Z][a-z]+ \\(([A-Z][a-z]+),', 1) AS role FROM docs), rs AS (SELECT DISTINCT doc_id, text, role, unnest(regexp_extract_all(text, '([A-Z][a-z]+) \\(', 1)) AS family FROM r WHERE role <> ''), {near_cte('rs')} SELECT doc_id, family, role, near FROM nr",
        "form_fields": "WITH w AS (SELECT *, CASE WHEN l_partkey % 5 < 2 THEN 'Tx' WHEN l_partkey % 5 = 2 THEN 'Ch' ELSE 'Btn' END AS kind, CASE WHEN l_partkey % 2 = 0 THEN l_linestatus || ' ' || l_returnflag WHEN l_partkey % 11 = 0 THEN 'inherited' ELSE '' END AS value FROM lineitem), t AS (SELECT l_orderkey AS doc_id, CASE WHEN kind <> 'Btn' THEN trim(regexp_replace(value, '\\s+', ' ', 'g')) WHEN l_partkey % 7 = 0 THEN '' WHEN l_partkey % 4 >= 2 THEN '[x]' ELSE '[ ]' END AS text FROM w) SELECT doc_id, text, count(*) AS n FROM t WHERE text <> '' GROUP BY ALL",
        "free_gaps": "WITH w AS (SELECT l_orderkey, CAST(l_linenumber * 40 AS DOUBLE) AS x0, CAST(l_linenumber * 40 + 30 + l_partkey % 20 AS DOUBLE) AS x1 FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, -1.0, 0.0 FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 400.0, 401.0 FROM lineitem), r AS (SELECT l_orderkey, max(x1) OVER (PARTITION BY l_orderkey ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS a, lead(x0) OVER (PARTITION BY l_orderkey ORDER BY x0, x1) AS b FROM w) SELECT l_orderkey, greatest(a, 0.0) AS a, least(b, 400.0) AS b FROM r WHERE least(b, 400.0) - greatest(a, 0.0) >= 6",
        "reading_order": """WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS n, l_partkey % 7 = 0 AS over, 'p' || l_partkey || ' s' || l_suppkey || ' n' || l_linenumber AS a, 'r' || l_returnflag || ' t' || l_linestatus || ' m' || (l_partkey % 100) AS b FROM lineitem),
 i AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id, over, doc_id % 5 = 0 AND n > 3 ORDER BY n) AS g FROM l), s AS (SELECT *, NOT over AND count(*) OVER (PARTITION BY doc_id, over, doc_id % 5 = 0 AND n > 3, g) >= 3 AS split, min(n) OVER (PARTITION BY doc_id, over, doc_id % 5 = 0 AND n > 3, g) AS m FROM i),
 o AS (SELECT doc_id, CAST(n AS DOUBLE) AS x, 0 AS y, 0 AS z, a || ' ' || b AS t FROM s WHERE NOT split UNION ALL SELECT doc_id, m, 0, n, a FROM s WHERE split UNION ALL SELECT DISTINCT doc_id, m, 1, 0, '' FROM s WHERE split UNION ALL SELECT doc_id, m, 2, n, b FROM s WHERE split UNION ALL SELECT DISTINCT doc_id, m, 3, 0, '' FROM s WHERE split UNION ALL SELECT o_orderkey, 3.5, 0, 0, '| t |' FROM orders WHERE o_orderkey % 5 = 0)
 SELECT doc_id, trim(regexp_replace(string_agg(t, chr(10) ORDER BY x, y, z), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS text FROM o WHERE doc_id IN (SELECT o_orderkey FROM orders) GROUP BY 1""",
        "glyph_counts": "SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 AS INT) AS page, count(*) FILTER (l_partkey % 3 = 0) AS unmapped, count(*) AS total FROM lineitem GROUP BY ALL",
        "link_labels": "WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber * 40.0 AS x0, 30.0 + l_partkey % 20 AS wide, l_partkey % 5 * 12.0 AS top, 'w' || l_partkey || ',' AS t FROM lineitem), u AS (SELECT doc_id, trim(string_agg(t, ' ' ORDER BY top, x0, t), ' ,;.') AS label FROM w WHERE x0 + wide / 2 BETWEEN 50 AND 190 AND top + 5 BETWEEN 0 AND 40 GROUP BY 1) SELECT o_orderkey AS doc_id, coalesce(label, '') AS label FROM orders LEFT JOIN u ON u.doc_id = o_orderkey",
        "lost_from_pages": f"WITH {S.LAST}, {S.DOCS}, lr AS (SELECT record_id, doc_id, doi FROM records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY received_at DESC NULLS LAST, delivery_id DESC) = 1), v AS (SELECT doc_id, doi AS v FROM lr UNION SELECT l.doc_id, u.x.nameidentifier FROM creators c JOIN lr l USING (record_id), unnest(c.nameidentifiers) AS u(x)), i AS (SELECT DISTINCT doc_id, unnest(list_concat([upper(x) FOR x IN regexp_extract_all(v, '{P.ORCID}')], [lower(regexp_replace(x, '[.,;:)\\]}}>]+$', '')) FOR x IN regexp_extract_all(v, '{S.DOI}')])) AS identifier FROM v WHERE v IS NOT NULL) SELECT doc_id, string_agg(identifier, ',' ORDER BY identifier) AS lost FROM i JOIN docs d USING (doc_id) WHERE NOT contains({S.norm0(S.strip('d.text'))}, {S.norm0('identifier')}) GROUP BY 1",
        "bare_hosts": f"SELECT delivery_id, {S.norm('regexp_replace(coalesce(url, chr(0)), chr(1), chr(0))').replace('chr(0)', chr(39) * 2).replace('chr(1)', chr(39) + '^https?://[^/]+/(?:sample/)?' + chr(39))} AS bare, contains(coalesce(url, '') || CASE WHEN delivery_id % 5 = 0 THEN '???' ELSE '' END, '???') AS unfilled FROM records",
        "record_labels": f"WITH {NESTED}, f AS (SELECT c.record_id, string_agg(coalesce(nullif(familyname, ''), trim(split_part(coalesce(name, ''), ',', 1))), ';' ORDER BY seq_no, agent_id) AS families FROM creators c GROUP BY 1) SELECT l.record_id, coalesce(t.title, '') AS title, '' AS code, coalesce(d.description, '') AS abstract, coalesce(f.families, '') AS families FROM lastr l LEFT JOIN (SELECT * FROM ts WHERE i = 0) t USING (record_id) LEFT JOIN (SELECT * FROM ds WHERE i = 0) d USING (record_id) LEFT JOIN f USING (record_id)",
        "provenance_counts": f"WITH {ALL}, {EVERY}, e AS (SELECT doc_id, count(*) FILTER (severity = 'error') AS errors FROM every GROUP BY 1) SELECT d.doc_id, sha256(d.text) AS sha, CAST(length(d.text) AS BIGINT) AS chars, coalesce(e.errors, 0) AS errors FROM docs d LEFT JOIN e USING (doc_id)",
        "rejected_records": f"WITH {NESTED}, f AS (SELECT doc_id, min(record_id) AS record_id FROM lastr JOIN docs USING (doc_id) GROUP BY 1) SELECT DISTINCT f.doc_id, 'dateType' AS problems FROM f JOIN days USING (record_id) WHERE f.doc_id % 7 = 0",
        "strip_titles": f"WITH c AS (SELECT DISTINCT agent_id, name FROM creators WHERE name IS NOT NULL) SELECT agent_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '{_TITLE}', '\\1\\2', 'g'), '{_TITLE}', '\\1\\2', 'g'), '{_TITLE}', '\\1\\2', 'g'), '{S.SPACE}', ' ', 'g'), ' ,') AS bare FROM c",
        "enriched_people": f"""WITH p AS (SELECT DISTINCT agent_id, name, givenname, familyname, nameidentifiers FROM creators), i AS (SELECT p.agent_id, k, regexp_extract(coalesce(p.nameidentifiers[k].nameidentifier, ''), '{P.ORCID}') AS orcid, givenname, familyname FROM p, unnest(range(1, len(p.nameidentifiers) + 1)) AS u(k)),
 reg AS (SELECT orcid, {upper('givenname')} AS given, {upper('familyname')} AS family FROM i WHERE orcid <> '' AND givenname IS NOT NULL AND familyname IS NOT NULL QUALIFY row_number() OVER (PARTITION BY orcid ORDER BY {upper('givenname')} DESC, {upper('familyname')} DESC) = 1),
 f AS (SELECT i.agent_id, arg_min(reg.given, k) AS given, arg_min(reg.family, k) AS family FROM i JOIN reg USING (orcid) GROUP BY 1),
 n AS (SELECT p.*, f.given IS NOT NULL AS hit, {recased('f.family', 'p.familyname')} AS nf, {recased('f.given', 'p.givenname')} AS ng FROM p LEFT JOIN f USING (agent_id)),
 c AS (SELECT *, hit AND nf || ', ' || ng <> coalesce(name, '') AS ch FROM n)
 SELECT agent_id AS person_id, CASE WHEN ch THEN nf || ', ' || ng ELSE name END AS name, CASE WHEN ch THEN ng ELSE givenname END AS givenname, CASE WHEN ch THEN nf ELSE familyname END AS familyname, ch AS changed, coalesce(ch AND {name_key('nf')} <> {name_key("split_part(coalesce(name, ''), ',', 1)")}, false) AS differs FROM c""",
        "ror_choose": "SELECT label AS text, ror, label AS name FROM organisations WHERE org_id % 5 <> 0",
        "cached_answers": f"WITH {S.DOCS}, p AS (SELECT doc_id, text[1:{P.PROMPT_CHARS}] AS p FROM docs), k AS (SELECT DISTINCT p FROM p WHERE doc_id % 2 = 0) SELECT doc_id, k.p IS NOT NULL AS cached, CASE WHEN k.p IS NOT NULL THEN '{{\"samples\": []}}' WHEN p.p <> '' THEN '{{\"samples\": [], \"n_chars\": ' || length(p.p) || '}}' END AS content, CASE WHEN k.p IS NULL AND p.p = '' THEN 'empty prompt' END AS error FROM p LEFT JOIN k ON k.p = p.p",
        "loop_reason": f"WITH d AS (SELECT DISTINCT description_id, right(repeat(coalesce(description, ''), 5), {P.LOOP_TAIL}) AS t FROM descriptions), r AS (SELECT description_id, t, CASE WHEN length(t) >= 300 AND regexp_full_match(right(t, 300), '{S.SPACE[:-1]}*') THEN 0 ELSE list_min([p FOR p IN range(8, 401) IF length(t) >= p * greatest(4, CAST(ceil(400 / p) AS INT)) AND right(t, CAST(p * greatest(4, CAST(ceil(400 / p) AS INT)) AS BIGINT)) = repeat(right(t, p), greatest(4, CAST(ceil(400 / p) AS INT)))]) END AS p FROM d) SELECT description_id, CASE WHEN p = 0 THEN 'endless whitespace' ELSE 'repeats: ' || left(right(t, p), 70) END AS reason FROM r WHERE p IS NOT NULL",
        "tfidf_weights": f"WITH {_TFIDF} SELECT doc_id, idx, term, round(w, 6) AS w FROM w",
        "cosine_pairs": f"WITH {_TFIDF}, n AS (SELECT doc_id, side, idx, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL), u AS (SELECT w.doc_id, w.side, w.idx, w.term, w.w / n.norm AS w FROM w JOIN n USING (doc_id, side, idx) WHERE n.norm > 0) SELECT a.doc_id, a.idx AS g, b.idx AS o, round(0.9 * sum(a.w * b.w), 6) AS score FROM u a JOIN u b USING (doc_id, term) WHERE a.side = 'gold' AND b.side = 'ours' GROUP BY ALL",
    }


_TERMS = f"regexp_extract_all({S.norm('@')}, '[a-z]+\\d*|\\d+(?:\\.\\d+)?')"
_TFIDF = f"""{S.LAST}, t AS (SELECT record_id, title FROM titles QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY title_id) = 1), a AS (SELECT record_id, description AS abstract FROM descriptions QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY description_id) = 1),
 sides AS (SELECT CAST(floor(l.doc_id / 5) AS BIGINT) AS doc_id, CASE WHEN l.record_id % 2 = 1 THEN 'gold' ELSE 'ours' END AS side, l.record_id AS idx, coalesce(t.title, '') AS title, coalesce(a.abstract, '') AS abstract FROM last l JOIN documents USING (doc_id) LEFT JOIN t USING (record_id) LEFT JOIN a USING (record_id)),
 terms AS (SELECT doc_id, side, idx, unnest({_TERMS.replace('@', 'title')}) AS term, 2 AS k FROM sides UNION ALL SELECT doc_id, side, idx, unnest({_TERMS.replace('@', 'abstract')}), 1 FROM sides),
 tf AS (SELECT doc_id, side, idx, term, sum(k) AS tf FROM terms GROUP BY ALL), df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL), nn AS (SELECT doc_id, count(*) AS n FROM sides GROUP BY 1),
 w AS (SELECT tf.doc_id, tf.side, tf.idx, tf.term, tf.tf * ln(1 + nn.n / df.df) AS w FROM tf JOIN df USING (doc_id, term) JOIN nn USING (doc_id))"""
