"""SQL (DuckDB dialect) that states the registered queries over the same tables,
written on its own from the operators' rules."""
from __future__ import annotations

import re

from ..functions.text import DASHES, LIGATURES

_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda t: t <> '')"
_TERMS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: length(w) > 2)"
_NORM = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"


def slug(x):
    return _SLUG.format(x)


def norm(x):
    return _NORM.format(x)


def first_distinct(x):
    """Distinct elements in the order of their first place."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


_LEGAL = "('part_of','references','depends_on','causes','relates_to','example_of','is_a','has_a','uses')"

CTE = {
    "docs": "SELECT 'doc-' || doc_id AS document_id, doc_id, source AS category, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS pages FROM documents",
    "pg": "SELECT 'doc-' || doc_id AS document_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS page_number FROM documents WHERE text IS NOT NULL",
    "raw": f"""SELECT document_id, coalesce(nullif({slug("array_to_string(w[1:3], ' ')")}, ''), 'unknown') AS concept_id, array_to_string(w[1:3], ' ') AS name,
        content AS description, array_to_string(w[1:2], ' ') AS alias, list_distinct({_TERMS.format('content')}) AS keywords, page_number AS ord
        FROM (SELECT *, {_WORDS.format('content')} AS w FROM pg) WHERE len(w) > 0""",
    "con": """SELECT document_id, concept_id, arg_min(name, ord) AS name, arg_max(description, length(description) * 1000000 - ord) AS description,
        list_sort(list_distinct(list(ord))) AS pages, list_sort(list_distinct(list(lower(alias)))) AS aliases,
        list_sort(list_distinct(flatten(list(keywords)))) AS keywords, min(ord) AS ord FROM raw GROUP BY document_id, concept_id""",
    "rawedge": """SELECT a.document_id, a.concept_id AS source, b.concept_id AS target,
        CASE a.ord % 4 WHEN 0 THEN 'relates_to' WHEN 1 THEN 'depends_on' WHEN 2 THEN 'part_of' ELSE 'follows' END AS type, a.ord
        FROM raw a JOIN raw b ON a.document_id = b.document_id AND b.ord = a.ord + 1""",
    "edge": f"""SELECT document_id, source, target, CASE WHEN type IN {_LEGAL} THEN type ELSE 'relates_to' END AS type, ord
        FROM (SELECT DISTINCT * FROM rawedge) WHERE source <> target""",
    "alias": "SELECT document_id, lower(trim(alias)) AS alias, arg_max(concept_id, ord) AS concept_id FROM raw WHERE trim(alias) <> '' GROUP BY 1, 2",
    "ralias": "SELECT alias, arg_min(concept_id, CAST(substr(document_id, 5) AS BIGINT)) AS concept_id FROM alias GROUP BY alias",
    "post": "SELECT DISTINCT document_id, keyword, concept_id FROM (SELECT document_id, unnest(list_append(keywords, lower(name))) AS keyword, concept_id FROM con)",
    "rcon": "SELECT DISTINCT concept_id, document_id FROM con",
    "scope": "SELECT document_id FROM docs WHERE regexp_matches(category, '[02468]$')",
    "intent": f"""SELECT doc_id AS query_id, {first_distinct('names')} AS names, {first_distinct('kw')} AS keywords
        FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: array_to_string({_WORDS.format('l')}[1:3], ' ')), lambda t: t <> '') AS names,
            list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 10) AS kw FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL)""",
    "term": """SELECT query_id, unnest(names) AS term, 'concept' AS origin, generate_subscripts(names, 1) - 1 AS ord FROM intent
        UNION ALL SELECT query_id, unnest(keywords), 'keyword', generate_subscripts(keywords, 1) - 1 FROM intent""",
    "nterm": f"SELECT DISTINCT query_id, {norm('term')} AS term FROM term WHERE {norm('term')} <> ''",
    "seed": f"""SELECT DISTINCT query_id, concept_id FROM (
        SELECT t.query_id, a.concept_id FROM term t JOIN (SELECT alias, concept_id FROM ralias UNION SELECT alias, concept_id FROM alias) a ON a.alias = {norm('t.term')} WHERE t.origin = 'concept'
        UNION ALL SELECT query_id, {slug('term')} FROM term WHERE origin = 'concept' AND {slug('term')} <> '')""",
    "adj": "SELECT source AS a, target AS b FROM edge UNION SELECT target, source FROM edge",
    "d0": "SELECT DISTINCT s.query_id, s.concept_id FROM seed s JOIN adj ON adj.a = s.concept_id",
    "d1": "SELECT DISTINCT d.query_id, adj.b AS concept_id FROM d0 d JOIN adj ON adj.a = d.concept_id",
    "d2": "SELECT DISTINCT d.query_id, adj.b AS concept_id FROM d1 d JOIN adj ON adj.a = d.concept_id",
    "reach1": "SELECT query_id, concept_id, min(distance) AS distance FROM (SELECT *, 0 AS distance FROM d0 UNION ALL SELECT *, 1 FROM d1) GROUP BY 1, 2",
    "reach2": "SELECT query_id, concept_id, min(distance) AS distance FROM (SELECT *, 0 AS distance FROM d0 UNION ALL SELECT *, 1 FROM d1 UNION ALL SELECT *, 2 FROM d2) GROUP BY 1, 2",
    "cand": f"""SELECT DISTINCT query_id, concept_id, document_id FROM (
        SELECT t.query_id, r.concept_id, r.document_id FROM nterm t JOIN ralias a ON a.alias = t.term JOIN rcon r ON r.concept_id = a.concept_id
        UNION ALL SELECT t.query_id, r.concept_id, r.document_id FROM term t JOIN rcon r ON r.concept_id = {slug('t.term')}
        UNION ALL SELECT t.query_id, a.concept_id, a.document_id FROM nterm t JOIN alias a ON a.alias = t.term
        UNION ALL SELECT t.query_id, p.concept_id, p.document_id FROM nterm t JOIN post p ON p.keyword = t.term
        UNION ALL SELECT x.query_id, r.concept_id, r.document_id FROM reach1 x JOIN rcon r ON r.concept_id = x.concept_id)""",
    "npost": f"SELECT DISTINCT document_id, concept_id, {norm('keyword')} AS term FROM post",
    "size": "SELECT document_id, concept_id, count(*) AS len FROM npost GROUP BY 1, 2",
    "qdoc": "SELECT DISTINCT query_id, document_id FROM cand",
    "stat": "SELECT q.query_id, count(*) AS n, sum(s.len) / count(*)::DOUBLE AS avg FROM qdoc q JOIN size s ON s.document_id = q.document_id GROUP BY 1",
    "df": "SELECT t.query_id, t.term, count(*) AS df FROM nterm t JOIN npost p ON p.term = t.term JOIN qdoc q ON q.query_id = t.query_id AND q.document_id = p.document_id GROUP BY 1, 2",
    "bm": """SELECT * FROM (SELECT c.query_id, c.concept_id, c.document_id, round(sum(
            ln(1 + (st.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * 2.5::DOUBLE / (1 + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * s.len / st.avg))), 9) AS score
        FROM cand c JOIN npost p ON p.document_id = c.document_id AND p.concept_id = c.concept_id JOIN nterm t ON t.query_id = c.query_id AND t.term = p.term
        JOIN df ON df.query_id = t.query_id AND df.term = t.term JOIN stat st ON st.query_id = c.query_id
        JOIN size s ON s.document_id = c.document_id AND s.concept_id = c.concept_id GROUP BY 1, 2, 3) WHERE score > 0""",
    "al": f"""SELECT c.query_id, c.concept_id, c.document_id, count(*) AS matches FROM cand c JOIN nterm t ON t.query_id = c.query_id
        LEFT JOIN alias a ON a.document_id = c.document_id AND a.alias = t.term
        WHERE a.concept_id = c.concept_id OR {slug('t.term')} = c.concept_id GROUP BY 1, 2, 3""",
    "gseed": f"""SELECT DISTINCT query_id, concept_id FROM (
        SELECT t.query_id, a.concept_id FROM term t JOIN ralias a ON a.alias = {norm('t.term')} WHERE t.origin = 'concept'
        UNION ALL SELECT t.query_id, a.concept_id FROM term t JOIN alias a ON a.alias = {norm('t.term')} JOIN qdoc q ON q.query_id = t.query_id AND q.document_id = a.document_id WHERE t.origin = 'concept'
        UNION ALL SELECT query_id, {slug('term')} FROM term WHERE origin = 'concept' AND {slug('term')} <> '')""",
    "g0": "SELECT DISTINCT s.query_id, s.concept_id FROM gseed s JOIN adj ON adj.a = s.concept_id",
    "g1": "SELECT DISTINCT d.query_id, adj.b AS concept_id FROM g0 d JOIN adj ON adj.a = d.concept_id",
    "greach": "SELECT query_id, concept_id, min(distance) AS distance FROM (SELECT *, 0 AS distance FROM g0 UNION ALL SELECT *, 1 FROM g1) GROUP BY 1, 2",
    "gl": "SELECT c.query_id, c.concept_id, c.document_id, r.distance FROM cand c JOIN greach r ON r.query_id = c.query_id AND r.concept_id = c.concept_id",
    "lists": """SELECT query_id, concept_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concept_id, document_id) AS pos FROM bm
        UNION ALL SELECT query_id, concept_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, concept_id, document_id) FROM al
        UNION ALL SELECT query_id, concept_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, concept_id, document_id) FROM gl""",
    "fused": """SELECT c.query_id, c.concept_id, c.document_id, coalesce(s.score, 0::DOUBLE) AS score FROM cand c
        LEFT JOIN (SELECT query_id, concept_id, document_id, round(sum(1::DOUBLE / (60 + pos)), 9) AS score FROM lists GROUP BY 1, 2, 3) s USING (query_id, concept_id, document_id)""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concept_id, document_id) AS rank FROM fused",
    "top": "SELECT r.*, c.description, c.pages FROM ranked r JOIN con c USING (concept_id, document_id) WHERE rank <= 25",
    "top100": "SELECT r.*, c.description, c.pages FROM ranked r JOIN con c USING (concept_id, document_id) WHERE rank <= 100",
    "want": "SELECT query_id, document_id, page_number, min(rank) AS rank FROM (SELECT query_id, document_id, unnest(pages) AS page_number, rank FROM top WHERE rank <= 5) GROUP BY 1, 2, 3",
    "load": r"SELECT w.*, p.content, list_filter(regexp_split_to_array(lower(p.content), '\s+'), lambda t: t <> '') AS toks FROM want w JOIN pg p USING (document_id, page_number)",
    "pstat": "SELECT query_id, count(*) AS n, CASE WHEN avg(len(toks)) > 0 THEN avg(len(toks)) ELSE 1 END AS avg FROM load GROUP BY 1",
    "ptf": "SELECT l.query_id, l.document_id, l.page_number, l.len, l.term, count(*) AS tf FROM (SELECT query_id, document_id, page_number, len(toks) AS len, unnest(toks) AS term FROM load) l JOIN nterm t ON t.query_id = l.query_id AND t.term = l.term GROUP BY 1, 2, 3, 4, 5",
    "pdf": "SELECT query_id, term, count(*) AS df FROM ptf GROUP BY 1, 2",
    "praw": """SELECT f.query_id, f.document_id, f.page_number, sum(ln(1 + (s.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) * f.tf * 2.5::DOUBLE / (f.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * f.len / s.avg))) AS raw
        FROM ptf f JOIN pdf d USING (query_id, term) JOIN pstat s USING (query_id) GROUP BY 1, 2, 3""",
    "ev": """SELECT * FROM (SELECT query_id, document_id, page_number, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, page_number) AS position
        FROM (SELECT *, round(raw / max(raw) OVER (PARTITION BY query_id), 9) AS score FROM praw) WHERE score >= 0.3 AND score > 0) WHERE position <= 35""",
    "cite": """SELECT query_id, document_id, page_number, list(concept_id ORDER BY rank, concept_id) AS concepts, min(rank * 1000000 + p) AS first
        FROM (SELECT query_id, rank, concept_id, document_id, unnest(pages) AS page_number, generate_subscripts(pages, 1) AS p FROM top) GROUP BY 1, 2, 3""",
    "cited": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS ord FROM cite",
    "block": f"""SELECT query_id, 0 AS tier, 0 AS "at", '# Knowledge Context' AS text FROM (SELECT DISTINCT query_id FROM top)
        UNION ALL SELECT query_id, 1, 0, chr(10) || '## Tier 1: Concept Descriptions' FROM (SELECT DISTINCT query_id FROM top)
        UNION ALL SELECT query_id, 3, 0, chr(10) || '## Tier 2: Evidence Pages' FROM (SELECT DISTINCT query_id FROM top)
        UNION ALL SELECT query_id, 2, rank, chr(10) || rank || '. Concept `' || concept_id || '` (document: ' || document_id || ')' || chr(10) || '   ' || description FROM top
        UNION ALL SELECT e.query_id, 4, e.position, chr(10) || '### ' || e.document_id || ' — page ' || e.page_number || chr(10) || p.content FROM ev e JOIN pg p USING (document_id, page_number)""",
    "node0": "SELECT concept_id AS id, min(struct_pack(d := document_id, o := ord)) AS f, arg_min(name, struct_pack(d := document_id, o := ord)) AS label FROM con GROUP BY 1",
    "node": "SELECT id, f.d AS doc, f.o AS ord, label, row_number() OVER (ORDER BY f.d, f.o, id) - 1 AS idx FROM node0",
    "lnk": "SELECT document_id, source, target, type, ord, 1 AS weight FROM edge",
    "deg": "SELECT n.*, coalesce(c, 0) AS degree FROM node n LEFT JOIN (SELECT id, count(*) AS c FROM (SELECT source AS id FROM lnk UNION ALL SELECT target FROM lnk) GROUP BY 1) d USING (id)",
    "reachable": "SELECT id AS u, id AS v FROM node UNION SELECT r.u, adj.b FROM reachable r JOIN adj ON adj.a = r.v",
    "label": "SELECT r.u AS id, min(n.idx) AS label FROM reachable r JOIN node n ON n.id = r.v GROUP BY 1",
    "comp": "SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS component FROM label",
    "hidden": "SELECT component FROM comp GROUP BY 1 HAVING count(*) <= 2",
    "shown": "SELECT n.*, c.component FROM node n JOIN comp c USING (id) WHERE c.component NOT IN (SELECT component FROM hidden)",
    "media": "SELECT 'web-' || (page_id // 10) AS document_id, page_id AS page_number, CASE WHEN page_id % 5 = 0 THEN 'img/' || page_id || '.png' ELSE url END AS content FROM pages",
    "kind": r"SELECT *, CASE WHEN regexp_matches(trim(content), '(?i)^.+\.(webp|png|jpe?g|gif|bmp)$') AND NOT contains(trim(content), chr(10)) THEN 'image' ELSE 'text' END AS content_type FROM media",
    "chg": "SELECT *, CASE WHEN lag(content_type) OVER (PARTITION BY document_id ORDER BY page_number) = content_type THEN 0 ELSE 1 END AS c FROM kind",
    "run": "SELECT *, CAST(sum(c) OVER (PARTITION BY document_id ORDER BY page_number) AS BIGINT) AS run FROM chg",
    "chunk": "SELECT *, (row_number() OVER (PARTITION BY document_id, run ORDER BY page_number) - 1) // (CASE WHEN content_type = 'image' THEN 1 ELSE 3 END) AS chunk FROM run",
    "batch": "SELECT *, dense_rank() OVER (PARTITION BY document_id ORDER BY run, chunk) AS batch_id FROM chunk",
    "gloss": rf"SELECT 'conv-' || conv_id AS document_id, conv_id, lower(array_to_string({_WORDS.format('text')}[1:3], ' ')) AS key, text AS definition, turn FROM conversations WHERE role = 'user'",
    "usage": "SELECT event_type AS document_name, event_id AS call_id, ts, CAST(floor(coalesce(value, 0)) AS BIGINT) AS input_tokens, event_id % 97 AS output_tokens FROM events",
    "framed": "SELECT source AS document_id, doc_id AS page_number, 'Source ' || source || chr(10) || text || chr(10) || 'End of ' || source AS content FROM documents WHERE text IS NOT NULL",
    "fline": r"SELECT document_id, page_number, trim(unnest(string_split(content, chr(10)))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM framed",
    "fpos": "SELECT *, (row_number() OVER (PARTITION BY document_id, page_number ORDER BY i) - 1) / greatest(count(*) OVER (PARTITION BY document_id, page_number) - 1, 1)::DOUBLE AS pos FROM fline WHERE line <> ''",
    "rep": "SELECT document_id, line, count(*) AS n, avg(pos) AS mean_position FROM fpos GROUP BY 1, 2",
    "headed": "SELECT r.document_id, r.line, r.n FROM rep r JOIN (SELECT document_id, count(*) AS pages FROM framed GROUP BY 1) p USING (document_id) WHERE p.pages >= 3 AND r.n >= 3 AND r.n >= 0.5 * p.pages AND (r.mean_position < 0.15 OR r.mean_position > 0.85)",
    "tagged": "SELECT document_id, CASE WHEN doc_id % 2 = 0 THEN [category, 'größe'] ELSE [] END AS tags FROM docs",
    "checked": """SELECT document_id, ord AS page_number, CASE WHEN ord % 11 = 0 THEN 'missing name' WHEN ord % 7 = 0 THEN 'unknown pages' END AS reason FROM raw""",
}


def sql(final: str) -> str:
    """``final`` with the common tables that it needs, in order."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+\(?\s*([a-z0-9_]+)", text):
            visit(name)

    seen: set[str] = set()

    def visit(name: str) -> None:
        if name in CTE and name not in seen:
            seen.add(name)
            add(CTE[name])
            need.append(name)

    add(final)
    if not need:
        return final
    word = "WITH RECURSIVE " if "reachable" in need else "WITH "
    return word + ",\n".join(f"{n} AS ({CTE[n]})" for n in need) + "\n" + final


def _join(x, sep=","):
    return f"array_to_string({x}, '{sep}')"


_ESC = "replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')"
_D = DASHES
_lig = "'ﬁne ﬂow oﬃce ' || p_name"
for _sign, _letters in LIGATURES.items():
    _lig = f"replace({_lig}, '{_sign}', '{_letters}')"
_MD = """rtrim('# ' || t.document_id || chr(10) || chr(10) || '## Metadata' || chr(10) || chr(10) ||
    CASE WHEN len(t.tags) > 0 THEN array_to_string(list_transform(t.tags, lambda x: '- ' || x), chr(10)) ELSE '- _No metadata_' END ||
    chr(10) || chr(10) || '---' || chr(10) || chr(10) || coalesce(b.body, ''), ' ' || chr(9) || chr(10) || chr(13)) || chr(10)"""
_TX = """'FILE_NAME : ' || t.document_id || chr(10) || 'METADATA : [' || array_to_string(list_transform(t.tags, lambda x: '"' || replace(replace(x, 'ö', '\\u00f6'), 'ß', '\\u00df') || '"'), ', ') || ']' ||
    chr(10) || chr(10) || repeat('-', 51) || coalesce(chr(10) || b.body, '')"""
_DASH = f"regexp_replace(regexp_replace({{0}}, '([0-9^eE])[{_D}]([0-9])', '\\1-\\2', 'g'), '([0-9^eE])[{_D}]([0-9])', '\\1-\\2', 'g')"



def _context(tokens: int) -> str:
    return rf"""SELECT query_id, left(string_agg(shown, chr(10) ORDER BY tier, "at"), {4 * tokens}) AS x FROM (
        SELECT *, CASE WHEN cum <= {tokens} THEN text WHEN {tokens} - (cum - cost) > 0 AND part <> '' THEN part || chr(10) || '[... truncated to fit max_context_tokens]' END AS shown,
            count(*) FILTER (cum > {tokens}) OVER (PARTITION BY query_id ORDER BY tier, "at") AS ovr FROM (
            SELECT *, regexp_replace(left(text, CAST(greatest(0, ({tokens} - (cum - cost)) * 4 - 42) AS BIGINT)), '\s+$', '') AS part FROM (
                SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY tier, "at") AS cum FROM (SELECT *, CAST(ceil(length(text) / 4) AS BIGINT) AS cost FROM block))))
        WHERE ovr <= 1 AND shown IS NOT NULL GROUP BY 1"""


#: A line that is neither blank nor an item nor a heading.
_PLAIN = r"NOT regexp_matches({0}, '^\s*$|^\s*([-*+]|[0-9]+[.)])\s+|^\s*#{{1,6}}\s+')"

FINAL = {
    "s18_scope_scan": "SELECT p.document_id, keyword, concept_id FROM post p JOIN scope s USING (document_id)",
    "s19_bundle_list": "SELECT document_id, coalesce(nullif(category, ''), document_id) AS title, pages FROM docs",
    "s20_page_scan": "SELECT n.document_id, n.page_number, md5(CASE WHEN trim(coalesce(p.content, '')) = '' THEN 'no content' ELSE p.content END) AS content_md5 FROM (SELECT document_id, unnest(range(1, CAST(pages + 2 AS BIGINT))) AS page_number FROM docs) n LEFT JOIN pg p ON p.document_id = n.document_id AND p.page_number = n.page_number",
    "k1_format_markdown": f"SELECT document_id, length(x) AS chars, md5(x) AS text_md5 FROM (SELECT t.document_id, {_MD} AS x FROM tagged t LEFT JOIN (SELECT document_id, string_agg('# Page ' || page_number || chr(10) || chr(10) || content || chr(10), chr(10) ORDER BY page_number) AS body FROM pg GROUP BY 1) b USING (document_id))",
    "k2_format_text": f"SELECT document_id, length(x) AS chars, md5(x) AS text_md5 FROM (SELECT t.document_id, {_TX} AS x FROM tagged t LEFT JOIN (SELECT document_id, string_agg('PAGE_NO : ' || page_number || chr(10) || chr(10) || 'CONTENT:' || chr(10) || content || chr(10) || repeat('-', 51), chr(10) ORDER BY page_number) AS body FROM pg GROUP BY 1) b USING (document_id))",
    "k3_format_json": "SELECT t.document_id, array_to_string(t.tags, '|') AS tags, d.pages, md5(coalesce(b.body, '')) AS content_md5 FROM tagged t JOIN docs d USING (document_id) LEFT JOIN (SELECT document_id, string_agg(page_number || ':' || content, chr(10) ORDER BY page_number) AS body FROM pg GROUP BY 1) b USING (document_id)",
    "k8_usage_log": "SELECT document_name || ': ' || count(*) || ' calls, ' || sum(input_tokens) || ' in, ' || sum(output_tokens) || ' out, ' || sum(input_tokens + output_tokens) || ' total' AS line FROM usage GROUP BY document_name",
    "f1_classify": "SELECT document_id, page_number, content_type FROM kind",
    "f3_empty_pages": r"SELECT document_id, page_number, (regexp_matches(trim(content), '(?i)^.+\.(webp|png|jpe?g|gif|bmp)$') OR regexp_replace(content, '\s+', '', 'g') <> '') AS kept FROM pg",
    "f4_poor_pages": r"SELECT document_id, page_number, len(regexp_extract_all(content, '[\p{L}\p{N}_]+')) AS words FROM pg WHERE length(trim(content)) < 50 OR len(regexp_extract_all(content, '[\p{L}\p{N}_]+')) < 8",
    "f5_better_text": r"SELECT document_id, page_number, NOT (length(trim(o)) < 50 OR wo < 8) AND (length(trim(o)) > length(trim(content)) OR wo > wc) AS better FROM (SELECT *, len(regexp_extract_all(o, '[\p{L}\p{N}_]+')) AS wo, len(regexp_extract_all(content, '[\p{L}\p{N}_]+')) AS wc FROM (SELECT *, lead(content) OVER (PARTITION BY document_id ORDER BY page_number) AS o FROM pg)) WHERE o IS NOT NULL",
    "f6_page_numbers": "SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(list_filter([CAST(l_linenumber AS BIGINT), l_partkey, 3], lambda x: x BETWEEN 1 AND 100))), ',') AS pages FROM lineitem",
    "f11_validate_concepts": "SELECT document_id, page_number, reason IS NULL AS valid, reason FROM checked",
    "f12_validate_keywords": "SELECT conv_id, turn, count(*) AS words FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations) WHERE regexp_replace(w, '\\s', '', 'g') <> '' GROUP BY 1, 2",
    "f13_validate_entries": "SELECT document_id, key, turn AS page_number FROM gloss WHERE key <> '' AND conv_id % 5 <> 0",
    "f15_graph_edges": "SELECT document_id, source, target, type, CAST(ord AS VARCHAR) AS pages FROM edge",
    "f16_evidence_floor": "SELECT l.query_id, l.loaded, coalesce(e.kept, 0) AS kept, e.least FROM (SELECT query_id, count(*) AS loaded FROM load GROUP BY 1) l LEFT JOIN (SELECT query_id, count(*) AS kept, round(min(score), 6) AS least FROM ev GROUP BY 1) e USING (query_id)",
    "f2_image_paths": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/abs/' || page_id || '.png' WHEN 1 THEN CASE page_id % 2 WHEN 0 THEN '/store/up/' ELSE '/docs/up/' END || page_id || '.png' ELSE CASE page_id % 2 WHEN 0 THEN '/store/data/img/' ELSE '/docs/web/img/' END || page_id || '.png' END AS path FROM pages",
    "f14_image_errors": "SELECT document_id, batch_id, page_number, 'Batch ' || batch_id || ': image file for page ' || page_number || ' not readable: ' || content AS error FROM batch WHERE content_type = 'image' AND page_number % 10 = 0",
    "f17_scope": "SELECT document_id FROM docs WHERE doc_id IN (7, 14, 100)",
    "f18_concept_search": "SELECT document_id, concept_id FROM con WHERE contains(lower(name), 'than') OR contains(lower(description), 'than') OR len(list_filter(keywords, lambda k: contains(k, 'than'))) > 0",
    "f19_question_search": "SELECT document_id, concept_id FROM (SELECT *, lower(name || ' ' || array_to_string(keywords, ' ') || ' ' || description) AS hay FROM con) WHERE contains(hay, 'where') OR contains(hay, 'the') OR contains(hay, 'scum')",
    "f20_links": "SELECT document_id, source, target, type, weight FROM lnk",
    "f21_subgraph": "SELECT 'node' AS kind, id AS a, NULL::VARCHAR AS b FROM shown UNION ALL SELECT 'link', l.source, l.target FROM lnk l JOIN shown s ON s.id = l.source JOIN shown t ON t.id = l.target",
    "f22_dim": "SELECT id, NOT contains(lower(label), 'than') AS dim FROM node",
    "f23_incident": "SELECT c.id AS concept, l.document_id, l.source, l.target, CASE WHEN l.source = c.id THEN l.target ELSE l.source END AS other, o.label AS other_label FROM lnk l JOIN node c ON c.idx < 5 AND (l.source = c.id OR l.target = c.id) JOIN node o ON o.id = CASE WHEN l.source = c.id THEN l.target ELSE l.source END",
    "f24_find_first": "SELECT arg_min(id, idx) AS id FROM node WHERE contains(lower(label), 'than')",
    "f25_answer_nodes": f"SELECT DISTINCT t.query_id, n.id FROM term t JOIN node n ON n.id = {slug('t.term')} WHERE t.origin = 'concept'",
    "j1_alias_join": "SELECT DISTINCT t.query_id, r.concept_id, r.document_id FROM nterm t JOIN ralias a ON a.alias = t.term JOIN rcon r ON r.concept_id = a.concept_id JOIN scope s ON s.document_id = r.document_id",
    "j2_slug_join": f"SELECT DISTINCT t.query_id, r.concept_id, r.document_id FROM term t JOIN rcon r ON r.concept_id = {slug('t.term')}",
    "j3_local_alias": "SELECT DISTINCT t.query_id, a.document_id, a.concept_id FROM nterm t JOIN alias a ON a.alias = t.term",
    "j4_keyword_join": "SELECT t.query_id, p.keyword, count(*) AS hits FROM nterm t JOIN post p ON p.keyword = t.term JOIN scope s ON s.document_id = p.document_id GROUP BY 1, 2",
    "j5_scope_intersection": "SELECT concept_id, count(*) AS n_documents FROM rcon r JOIN scope s ON s.document_id = r.document_id GROUP BY 1",
    "j6_hydrate": f"SELECT query_id, c.concept_id, c.document_id, {_join('k.pages')} AS pages, length(k.description) AS chars FROM cand c JOIN con k ON k.concept_id = c.concept_id AND k.document_id = c.document_id",
    "j7_seeds": "SELECT query_id, concept_id FROM seed",
    "j8_evidence_join": "SELECT query_id, document_id, page_number, row_number() OVER (PARTITION BY query_id ORDER BY rank, page_number, document_id) AS position FROM load",
    "j9_loaded_flag": "SELECT c.query_id, c.document_id, c.page_number, e.position IS NOT NULL AS evidence_loaded FROM cite c LEFT JOIN ev e USING (query_id, document_id, page_number)",
    "j12_labels": "SELECT DISTINCT e.target AS id, coalesce(n.label, e.target) AS label FROM edge e LEFT JOIN node n ON n.id = e.target",
    "a1_merge_concepts": f"SELECT document_id, concept_id, name, md5(description) AS description_md5, {_join('pages')} AS pages, {_join('aliases', '|')} AS aliases, {_join('keywords')} AS keywords FROM con",
    "a2_edge_dedup": "SELECT DISTINCT document_id, source, target, type, CAST(ord AS VARCHAR) AS pages FROM rawedge",
    "a3_keyword_set": "SELECT DISTINCT document_id, unnest(keywords) AS keyword FROM raw",
    "a4_alias_last": "SELECT document_id, alias, concept_id FROM alias",
    "a5_glossary_first": "SELECT document_id, key, md5(arg_min(definition, turn)) AS definition_md5, min(turn) AS page_number FROM gloss WHERE key <> '' GROUP BY 1, 2",
    "a6_pages_extracted": "SELECT document_id, count(*) AS pages_extracted FROM batch GROUP BY 1",
    "a7_keyword_index": "SELECT document_id, keyword, string_agg(concept_id, ',' ORDER BY concept_id) AS concept_ids FROM post GROUP BY 1, 2",
    "a8_page_index": "SELECT document_id, page_number, string_agg(concept_id, ',' ORDER BY ord, concept_id) AS concept_ids FROM (SELECT document_id, unnest(pages) AS page_number, concept_id, ord FROM con) GROUP BY 1, 2",
    "a9_entry_index": "SELECT document_id, key, min(turn) AS page_number FROM gloss WHERE key <> '' GROUP BY 1, 2",
    "a10_validation": "SELECT document_id, count(*) AS total, count(*) FILTER (reason IS NULL) AS valid, count(*) FILTER (reason IS NOT NULL) AS invalid FROM checked GROUP BY 1",
    "a11_concept_docs": "SELECT concept_id, string_agg(document_id, ',' ORDER BY document_id) AS documents FROM rcon GROUP BY 1",
    "a12_keyword_docs": "SELECT keyword, string_agg(document_id, ',' ORDER BY document_id) AS documents FROM (SELECT DISTINCT keyword, document_id FROM post) GROUP BY 1",
    "a13_alias_first": "SELECT alias, concept_id FROM ralias",
    "a14_tags": "SELECT category, string_agg(document_id, ',' ORDER BY document_id) AS documents FROM (SELECT DISTINCT category, document_id FROM docs) WHERE category <> '' GROUP BY 1",
    "a15_statistics": "SELECT (SELECT count(*) FROM docs) AS documents, (SELECT CAST(sum(pages) AS BIGINT) FROM docs) AS pages, (SELECT count(DISTINCT concept_id) FROM con) AS concepts, (SELECT count(*) FROM edge) AS relationships",
    "a16_global_graph": "SELECT 'edge' AS kind, document_id, source AS id, target, type, CAST(ord AS VARCHAR) AS pages FROM edge UNION ALL SELECT DISTINCT 'node', NULL, concept_id, NULL, NULL, NULL FROM con",
    "a17_bm25_stats": "SELECT query_id, n, round(avg, 6) AS avg FROM stat",
    "a18_bm25": "SELECT query_id, concept_id, document_id, round(score, 6) AS score FROM bm",
    "a19_page_bm25": "SELECT query_id, document_id, page_number, round(score, 6) AS score, position FROM ev",
    "a20_alias_count": "SELECT query_id, concept_id, document_id, matches FROM al",
    "a21_rrf": "SELECT query_id, concept_id, document_id, round(score, 6) AS score, rank FROM ranked",
    "a22_citations": f"SELECT query_id, ord, document_id, page_number, {_join('concepts')} AS concepts FROM cited",
    "a23_response": "SELECT query_id, array_to_string(list_sort(list_distinct(list(document_id))), ',') AS documents_used, string_agg(concept_id, ',' ORDER BY rank) AS concepts_used FROM top GROUP BY 1",
    "a24_repeated_lines": "SELECT document_id, md5(line) AS line_md5, n, round(mean_position, 6) AS mean_position FROM rep WHERE n >= 3",
    "a25_usage": "SELECT document_name, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens FROM usage GROUP BY 1",
    "a26_degree": "SELECT id, degree FROM deg",
    "a27_clusters": "SELECT component, CAST(sum(n) AS BIGINT) AS size, arg_max(doc, n * 100000000 - first) AS dominant_doc FROM (SELECT c.component, n.doc, count(*) AS n, min(n.idx) AS first FROM comp c JOIN node n USING (id) GROUP BY 1, 2) GROUP BY 1",
    "a28_merged_graph": "SELECT 'node' AS kind, doc AS document_id, id, NULL::VARCHAR AS other, idx AS n FROM node UNION ALL SELECT 'link', document_id, source, target, weight FROM lnk",
    "a29_link_weight": "SELECT weight, count(*) AS links FROM lnk GROUP BY 1",
    "a30_totals": "SELECT (SELECT count(*) FROM node) AS nodes, (SELECT count(DISTINCT doc) FROM node) AS documents, (SELECT CAST(sum(pages) AS BIGINT) FROM docs) AS pages, (SELECT count(*) FROM lnk) AS links",
    "a31_neighbours": "SELECT a AS id, string_agg(b, ',' ORDER BY b) AS neighbours FROM adj GROUP BY 1",
    "a32_visible_counts": "SELECT (SELECT count(*) FROM shown) AS visible, (SELECT count(DISTINCT component) FROM shown) AS components, (SELECT count(*) FROM node) AS nodes, (SELECT count(*) FROM lnk l JOIN shown s ON s.id = l.source JOIN shown t ON t.id = l.target) AS links",
    "w1_runs": "SELECT document_id, page_number, run FROM run",
    "w2_batches": "SELECT document_id, page_number, batch_id FROM batch",
    "w3_batch_text": "SELECT document_id, batch_id, content_type, string_agg(page_number, ',' ORDER BY page_number) AS pages, md5(CASE WHEN content_type = 'text' THEN string_agg('### Page ' || page_number || chr(10) || content, chr(10) || chr(10) ORDER BY page_number) ELSE '' END) AS text_md5 FROM batch GROUP BY 1, 2, 3",
    "w4_ranked_lists": "SELECT query_id, concept_id, document_id, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concept_id, document_id) AS position FROM bm) WHERE position <= 10",
    "w5_final_rank": "SELECT query_id, rank, concept_id, document_id FROM ranked WHERE rank <= 25",
    "w6_context_budget": f"SELECT query_id, length(x) AS chars, md5(x) AS context_md5 FROM ({_context(500)})",
    "e17_truncate": f"SELECT query_id, x AS context FROM ({_context(60)})",
    "w7_context_order": "SELECT query_id, tier, \"at\", CAST(ceil(length(text) / 4) AS BIGINT) AS cost FROM block",
    "w8_parallel_edges": "SELECT document_id, source, target, type, ord, pair_index, CASE WHEN n > 1 THEN 0.25::DOUBLE * (pair_index - (n - 1) / 2.0::DOUBLE) ELSE 0::DOUBLE END AS curvature FROM (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY document_id, ord, source, type) - 1 AS pair_index, count(*) OVER (PARTITION BY least(source, target), greatest(source, target)) AS n FROM lnk)",
    "w9_call_numbers": "SELECT document_name, call_id, call_number FROM (SELECT *, row_number() OVER (PARTITION BY document_name ORDER BY ts, call_id) AS call_number FROM usage) WHERE call_number <= 100",
    "w10_radius": "SELECT id, round(least(32::DOUBLE, greatest(6::DOUBLE, 6 + degree / greatest(1, max(degree) OVER ())::DOUBLE * 26)), 6) AS radius, (degree * 7 + idx * 3) % 30 AS palette FROM deg",
    "t5_candidate_order": "SELECT query_id, concept_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY concept_id, document_id) AS position FROM cand",
    "t6_top_labels": "SELECT id FROM (SELECT *, row_number() OVER (ORDER BY degree DESC, idx) AS p FROM deg) WHERE p <= 30 OR degree >= 4",
    "t7_cards": "SELECT document_id, concept_id, array_to_string(keywords[1:4], ',') AS tags, md5(CASE WHEN length(description) > 140 THEN left(description, 140) || '…' ELSE description END) AS text_md5 FROM con",
    "x1_candidates": "SELECT query_id, concept_id, document_id FROM cand",
    "x2_plan_terms": "SELECT query_id, origin, term, ord FROM term",
    "x3_query_terms": "SELECT query_id, term FROM nterm",
    "x6_unknown_scope": "SELECT DISTINCT 'doc-' || (doc_id * 2) AS document_id FROM labels WHERE 'doc-' || (doc_id * 2) NOT IN (SELECT document_id FROM docs)",
    "x7_upsert": "SELECT e.document_id, source, target, type FROM edge e JOIN docs d USING (document_id) WHERE d.doc_id % 3 <> 0 UNION ALL SELECT e.document_id, target, source, 'uses' FROM edge e JOIN docs d USING (document_id) WHERE d.doc_id % 3 = 0",
    "e1_slugify": f"SELECT p_partkey, coalesce(nullif({slug(chr(39).join(['p_name || ', ' / ', ' || p_type']))}, ''), 'unknown') AS slug FROM part",
    "e2_normalize": f"SELECT conv_id, turn, md5({norm('text')}) AS term_md5 FROM conversations",
    "e3_tokens": r"SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> ''), ' ') AS tokens FROM conversations",
    "e4_fallback_tokens": f"SELECT conv_id, turn, array_to_string({_TERMS.format('text')}, ' ') AS words FROM conversations",
    "e7_ligatures": f"SELECT p_partkey, {_lig} AS text FROM part",
    "e9_dashes": "SELECT c_custkey, " + _DASH.format("c_custkey || '–' || c_nationkey || '−1 a–b 10^‒4 e—7'") + " AS text FROM customer",
    "e10_scientific": "SELECT c_custkey, regexp_replace(regexp_replace(" + _DASH.format("'10^^^' || c_nationkey || '‒2 ^+-3'") + r", '\^\^+', '^', 'g'), '\^\+-', '^-', 'g') AS text FROM customer",
    "e11_blank_lines": "SELECT c_custkey, regexp_replace(c_name || repeat(chr(10), CAST(c_custkey % 6 AS BIGINT)) || 'x', '\\n{3,}', chr(10) || chr(10), 'g') AS text FROM customer",
    "e14_headers": "SELECT document_id, line, n FROM headed",
    "e16_tokens": "SELECT document_id, CAST(sum(ceil(length(content) / 4)) AS BIGINT) AS tokens FROM pg GROUP BY 1",
    "e22_data_urls": "SELECT page_id, m AS mime, md5('data:' || m || ';base64,' || to_base64(encode(url))) AS url_md5 FROM (SELECT page_id, url, CASE page_id % 7 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/gif' WHEN 4 THEN 'image/bmp' ELSE 'image/webp' END AS m FROM pages)",
    "e8_whitespace": r"SELECT conv_id, turn, md5(array_to_string(list_transform(string_split(chr(9) || ' ' || replace(text, ' ', '  ' || chr(9)) || ' ' || chr(10) || '  x  y ', chr(10)), lambda l: regexp_replace(trim(l, ' ' || chr(9)), '[ \t]+', ' ', 'g')), chr(10))) AS text_md5 FROM conversations",
    "e12_paragraphs": rf"""SELECT doc_id, md5(substr(array_to_string(list_transform(l, lambda s, i: CASE WHEN i > 1 AND ({_PLAIN.format('s')}) AND length(s) < 120 AND l[i - 1] <> '' AND NOT regexp_matches(l[i - 1], '[.:?!]$') AND ({_PLAIN.format('l[i - 1]')}) THEN ' ' ELSE chr(10) END || s), ''), 2)) AS text_md5
        FROM (SELECT doc_id, string_split(regexp_replace(text, '([,.]) ', '\1' || chr(10), 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL)""",
    "e26_answers": f"""SELECT conv_id, turn, md5(array_to_string(list_transform(list_filter(regexp_split_to_array({_ESC.replace("coalesce(html, '')", 'x')}, '\\n{{2,}}'), lambda p: trim(p, ' ' || chr(9) || chr(10)) <> ''), lambda p: '<p>' || replace(trim(p, ' ' || chr(9) || chr(10)), chr(10), '<br>') || '</p>'), '')) AS html_md5
        FROM (SELECT conv_id, turn, text || chr(10) || chr(10) || ' <b>&' || chr(10) || 'next' || repeat(chr(10), 3) || role AS x FROM conversations)""",
    "e15_clean_documents": "SELECT f.document_id, f.page_number, md5(CASE WHEN g.l IS NULL THEN f.content ELSE array_to_string(list_filter(CASE WHEN string_split(f.content, chr(10))[-1] = '' THEN string_split(f.content, chr(10))[1:-2] ELSE string_split(f.content, chr(10)) END, lambda s: NOT list_contains(g.l, trim(s))), chr(10)) END) AS content_md5 FROM framed f LEFT JOIN (SELECT document_id, list(line) AS l FROM headed GROUP BY 1) g USING (document_id)",
    "g6_forces": "SELECT id, round(4 + least(32::DOUBLE, greatest(6::DOUBLE, 6 + degree / greatest(1, max(degree) OVER ())::DOUBLE * 26)), 6) AS collide, CASE WHEN degree = 0 THEN -60::DOUBLE ELSE -200 - 3 * degree::DOUBLE END AS charge FROM deg",
    "e23_filenames": r"""SELECT p_partkey, regexp_replace(regexp_replace(' a/b:' || p_name || '?.. ', '[\\/:*?"<>|]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS name FROM part""",
    "e24_model_id": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'lab/' || n_name ELSE 'provider/' || n_name END AS model FROM nation",
    "e25_escape": f"SELECT page_id, md5({_ESC}) AS html_md5 FROM pages",
    "e27_rgb": "SELECT n_nationkey, ((n_nationkey * 654321) >> 16) || ',' || (((n_nationkey * 654321) >> 8) & 255) || ',' || ((n_nationkey * 654321) & 255) AS rgb FROM nation",
    "e28_strokes": "SELECT weight, round(max(least(1.2::DOUBLE + 2 * least(weight - 1, 4), 8)), 6) AS width, round(max(0.3::DOUBLE + 0.4::DOUBLE * least(weight / 3::DOUBLE, 1)), 6) AS alpha, round(max(35 + 25 / weight::DOUBLE), 6) AS distance FROM lnk GROUP BY 1",
    "e29_display_time": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS shown FROM orders",
    "g1_adjacency": "SELECT a, b FROM adj",
    "g2_bfs": "SELECT query_id, concept_id, distance FROM reach2",
    "g3_expansion": "SELECT r.query_id, r.concept_id, c.document_id FROM reach1 r JOIN rcon c USING (concept_id) JOIN scope s ON s.document_id = c.document_id",
    "g4_graph_rank": "SELECT query_id, concept_id, document_id, distance FROM gl",
    "g5_components": "SELECT id, component FROM comp",
    "g7_neighbourhood": "SELECT c.id AS centre, a.b AS id FROM node c JOIN adj a ON a.a = c.id WHERE c.idx < 5 UNION SELECT id, id FROM node WHERE idx < 5",
    "u6_no_result": "SELECT query_id FROM intent WHERE query_id NOT IN (SELECT query_id FROM cand)",
    "ask_end_to_end": f"SELECT c.query_id, c.ord, c.document_id, c.page_number, {_join('c.concepts')} AS concepts, e.position IS NOT NULL AS evidence_loaded FROM cited c LEFT JOIN ev e USING (query_id, document_id, page_number)",
}

_BENCH = {
    "term": f"SELECT item_id AS query_id, unnest(list_distinct({_TERMS.format('text')})) AS term, 'keyword' AS origin, 0 AS ord FROM benchmark",
    "cand": f"""SELECT DISTINCT query_id, concept_id, document_id FROM (
        SELECT t.query_id, r.concept_id, r.document_id FROM nterm t JOIN ralias a ON a.alias = t.term JOIN rcon r ON r.concept_id = a.concept_id
        UNION ALL SELECT t.query_id, r.concept_id, r.document_id FROM term t JOIN rcon r ON r.concept_id = {slug('t.term')}
        UNION ALL SELECT t.query_id, a.concept_id, a.document_id FROM nterm t JOIN alias a ON a.alias = t.term
        UNION ALL SELECT t.query_id, p.concept_id, p.document_id FROM nterm t JOIN post p ON p.keyword = t.term)""",
}


def _with(tables: dict[str, str], final: str) -> str:
    """``final`` with some of the common tables changed."""
    own = {k: CTE[k] for k in tables}
    CTE.update(tables)
    try:
        return sql(final)
    finally:
        CTE.update(own)


_TOP_100 = {"want": "SELECT query_id, document_id, page_number, min(rank) AS rank FROM (SELECT query_id, document_id, unnest(pages) AS page_number, rank FROM top100) GROUP BY 1, 2, 3"}
ORACLE_SQL = {name: sql(text) for name, text in FINAL.items()} | {
    "bench_bm25": _with(_BENCH, "SELECT query_id, position, concept_id, document_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concept_id, document_id) AS position FROM bm) WHERE position <= 5"),
    "t3_evidence_cap": _with(_TOP_100, "SELECT query_id, position, document_id, page_number, round(score, 6) AS score FROM ev"),
}
