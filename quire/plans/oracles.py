"""SQL that gives the rows of the registered queries."""

from __future__ import annotations

from quire.functions.text import QUESTION_WORDS, STOPWORDS

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS + QUESTION_WORDS) + "]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def _keywords(text: str, most: int = 10) -> str:
    found = f"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x) AND NOT regexp_matches(x, '^[0-9]+$'))"
    return f"(SELECT list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, {most}) FROM (SELECT {found} AS w))"


def _number(text: str) -> tuple[str, str]:
    """Base and full reference number."""
    of = lambda rest, k: f"nullif(regexp_extract({text}, '(?i)\\bOrder\\s*{rest}\\b', {k}), '')"
    exact, five, base = "(6\\d{3})\\s*[-–—]?\\s*(\\d)", "(6\\d{3})(\\d)", "(6\\d{3})"
    return f"coalesce({of(exact, 1)}, {of(five, 1)}, {of(base, 1)})", f"{of(exact, 1)} || '-' || {of(exact, 2)}"


_ITEMS = "SELECT item_id AS q_id, text AS question FROM benchmark"
_CHUNKS = "SELECT doc_id AS chunk_id, text FROM documents"


def _asked(questions: str = _ITEMS, whole: bool = False) -> str:
    words = "[question]" if whole else _keywords("question")
    return f"asked AS (SELECT * FROM (SELECT q_id, question, {words} AS words FROM ({questions})) WHERE len(words) > 0)"


def _bm25(chunks: str = _CHUNKS, name: str = "ft") -> str:
    """CTEs from ``asked`` to ``scored`` and the ranked ``name``."""
    split = "[^\\p{L}\\p{N}]+"
    return f"""
terms AS (SELECT DISTINCT q_id, term FROM (SELECT q_id, unnest(regexp_split_to_array(lower(w), '{split}')) AS term FROM (SELECT q_id, unnest(words) AS w FROM asked)) WHERE term <> ''),
split AS (SELECT chunk_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{split}'), lambda x: x <> '') AS t FROM ({chunks})),
stats AS (SELECT count(*) AS n_all, avg(len(t)) AS mean FROM split),
postings AS (SELECT chunk_id, any_value(size) AS size, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS size, unnest(t) AS term FROM split) WHERE term IN (SELECT term FROM terms) GROUP BY chunk_id, term),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scored AS (SELECT q_id, chunk_id, round(sum(ln(1 + (n_all - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM postings JOIN dfs USING (term) JOIN terms USING (term), stats GROUP BY q_id, chunk_id),
{name} AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM scored)"""


_VEC = """vec AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.vec_id AS q_id, c.vec_id AS chunk_id, round((1 + list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[])) / 2, 6) AS score FROM embeddings c, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark)))"""
_TOP = "SELECT q_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id)::INT AS rank FROM ({})) WHERE rank <= 8"
_BOTH = "(SELECT * FROM vec WHERE rank <= {v}) v FULL JOIN (SELECT * FROM ft WHERE rank <= {t}) f ON v.q_id = f.q_id AND v.chunk_id = f.chunk_id"
_KEYS = "coalesce(v.q_id, f.q_id) AS q_id, coalesce(v.chunk_id, f.chunk_id) AS chunk_id"


def _spaced(x: str) -> str:
    """A text whose words, hyphens among them, stand between blanks."""
    return f"' ' || replace(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_-]', ' ', 'g'), '-', ' - ') || ' '"


_HITS = "len(list_filter(words, lambda w: contains(spaced, ' ' || replace(w, '-', ' - ') || ' ')))"
_KEYWORD = f"""keyword AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY hit_count DESC, score DESC, chunk_id)::INT AS rank
  FROM (SELECT q_id, chunk_id, score, {_HITS}::INT AS hit_count FROM ft JOIN (SELECT chunk_id, {_spaced("text")} AS spaced FROM parts) USING (chunk_id) JOIN asked USING (q_id) WHERE ft.rank <= 80))"""
_PARTS = f"parts AS ({_CHUNKS})"
_RRF = _TOP.format(f"SELECT q_id, chunk_id, round(share + 0.15::DOUBLE * coalesce({_HITS}, 0), 9) AS score FROM (SELECT {_KEYS}, coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(0.8::DOUBLE / (60 + f.rank), 0) AS share FROM {_BOTH.format(v=25, t=60)}) LEFT JOIN (SELECT chunk_id, {_spaced('text')} AS spaced FROM parts) USING (chunk_id) LEFT JOIN asked USING (q_id)")
_ADDITIVE = _TOP.format(f"SELECT {_KEYS}, round(coalesce(v.score, 0) + coalesce(f.score, 0), 6) AS score FROM " + _BOTH.format(v=25, t=60))


def _stretched(table: str) -> str:
    span = "(max(score) OVER (PARTITION BY q_id) - min(score) OVER (PARTITION BY q_id))"
    return f"(SELECT q_id, chunk_id, CASE WHEN {span} <= 1e-12 THEN 1.0 ELSE (score - min(score) OVER (PARTITION BY q_id)) / {span} END AS score FROM {table} WHERE rank <= 8)"


_MINMAX = _TOP.format(f"SELECT {_KEYS}, round(0.6::DOUBLE * coalesce(v.score, 0) + 0.4::DOUBLE * coalesce(f.score, 0), 6) AS score FROM {_stretched('vec')} v FULL JOIN {_stretched('ft')} f ON v.q_id = f.q_id AND v.chunk_id = f.chunk_id")


def _spans(sections: str) -> str:
    """CTEs from ``sections`` (doc_id, section_index, text) to ``spans`` (..., chunk_index, piece, start_char, end_char, chunk_id).

    Each step of the recursion is one span; the step that ends a section may give a second one."""
    space = "instr(substr(text, a + 1001), ' ')"
    return f"""
secs AS (SELECT * FROM (SELECT doc_id, section_index, {_strip("text")} AS text FROM ({sections})) WHERE text <> ''),
steps AS (
  SELECT doc_id, section_index, 0 AS a, 0 AS step FROM secs
  UNION ALL
  SELECT doc_id, section_index, greatest(0, b - 200) AS a, step + 1 AS step FROM (
    SELECT doc_id, section_index, a, step, n, CASE WHEN {space} = 0 THEN a + 1000 ELSE a + 999 + {space} END AS b FROM (SELECT s.*, text, length(text) AS n FROM steps s JOIN secs USING (doc_id, section_index)) WHERE a + 1000 < n AND NOT (step = 0 AND n <= 2000))
  WHERE n - greatest(0, b - 200) > 2000),
cut AS (SELECT s.*, text, length(text) AS n, CASE WHEN a + 1000 >= length(text) OR (step = 0 AND length(text) <= 2000) THEN length(text) WHEN {space} = 0 THEN a + 1000 ELSE a + 999 + {space} END AS b FROM steps s JOIN secs USING (doc_id, section_index)),
ends AS (SELECT *, CASE WHEN n - greatest(0, b - 200) < 1000 THEN n ELSE b END AS stop, b < n AND n - greatest(0, b - 200) BETWEEN 1000 AND 2000 AS twice FROM cut),
pieces AS (
  SELECT doc_id, section_index, step, 0 AS part, a, substr(text, a + 1, stop - a) AS raw FROM ends
  UNION ALL
  SELECT doc_id, section_index, step, 1, greatest(0, b - 200), substr(text, greatest(0, b - 200) + 1) FROM ends WHERE twice),
moved AS (SELECT *, a + length(raw) - length(regexp_replace(raw, '^\\s+', '')) AS start_char, {_strip("raw")} AS piece FROM pieces),
spans AS (
  SELECT *, substr(sha256(doc_id || '|' || section_index || '|' || chunk_index || '|' || start_char || '|' || end_char), 1, 16) AS chunk_id
  FROM (SELECT doc_id, section_index, (row_number() OVER (PARTITION BY doc_id, section_index ORDER BY step, part) - 1)::INT AS chunk_index, piece, start_char::INT AS start_char, (start_char + length(piece))::INT AS end_char FROM moved WHERE piece <> ''))"""


_WHOLE = "SELECT doc_id, 0 AS section_index, text FROM documents"
_LINES = "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS section_index, unnest(string_split(text, chr(10))) AS text FROM documents"
_N_TOKENS = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> ''))::INT AS token_count"
_SPAN_ROWS = f"WITH RECURSIVE {_spans(_WHOLE)} SELECT doc_id, chunk_index, start_char, end_char, chunk_id, {_N_TOKENS.format('piece')} FROM spans"
_ANSWERS = f"""WITH RECURSIVE {_spans(_WHOLE)},
parts AS (SELECT chunk_id, piece AS text, doc_id, section_index, start_char FROM spans), {_asked()}, {_bm25("SELECT chunk_id, text FROM parts")}, {_KEYWORD},
seeds AS (SELECT q_id, rank, doc_id, section_index, start_char FROM keyword JOIN parts USING (chunk_id) WHERE rank <= 8),
near AS (SELECT q_id, chunk_id, min(rank) AS seed FROM seeds s JOIN parts p ON s.doc_id = p.doc_id AND s.section_index = p.section_index AND p.start_char BETWEEN s.start_char - 4000 AND s.start_char + 4000 GROUP BY q_id, chunk_id),
best AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY seed, chunk_id) AS rank FROM near),
blocks AS (SELECT q_id, rank, chunk_id, {_clean("text")} AS t FROM best JOIN parts USING (chunk_id) WHERE rank <= 8)
SELECT q_id, {_strip("string_agg('Context' || chr(10) || '[chunk_id=' || chunk_id || ']' || chr(10) || CASE WHEN length(t) > 1600 THEN regexp_replace(substr(t, 1, 1600), '\\s+$', '') ELSE t END || chr(10), chr(10) ORDER BY rank)")} AS context FROM blocks WHERE t <> '' GROUP BY q_id"""

_KNOWN = """known AS (SELECT url, min(CASE page_id % 6 WHEN 0 THEN ' Cancelled ' WHEN 2 THEN 'under review' ELSE '' END) AS state FROM pages WHERE page_id % 2 = 0 GROUP BY url),
catalog AS (SELECT substr(sha256(url), 1, 16) AS id, url, regexp_extract(url, '://([^/?#]*)', 1) AS domain, discoveredat, status, state FROM (
  SELECT url, '2024-01-01T00:00:00Z' AS discoveredat, 'parsed' AS status, state FROM known
  UNION ALL SELECT DISTINCT url, '2024-02-01T00:00:00Z', 'pending', '' FROM pages WHERE trim(url) <> '' AND url NOT IN (SELECT url FROM known)))"""
_PLAIN = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_LINKS = f"""found AS (SELECT page, html, regexp_extract(page, '^([a-z]+://[^/?#]*)', 1) || href AS url, place FROM (
  SELECT url AS page, html, {_PLAIN.format("unnest(regexp_extract_all(html, '<li><a href=\"([^\"]*)\"', 1))")} AS href, generate_subscripts(regexp_extract_all(html, '<li><a href="([^"]*)"', 1), 1) AS place FROM (SELECT DISTINCT url, html FROM pages))),
firsts AS (SELECT page, html, url, row_number() OVER (PARTITION BY page, html ORDER BY min(place)) - 1 AS place FROM found GROUP BY page, html, url)"""

_TURN = "SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN text ELSE text || ' Order 6' || lpad((conv_id % 1000)::VARCHAR, 3, '0') || CASE turn % 4 WHEN 0 THEN '-' || (turn % 10) WHEN 2 THEN '' ELSE ' x' END END AS question FROM conversations WHERE role = 'user'"
_REF_ITEMS = "SELECT item_id AS q_id, text || ' Order 600' || (item_id % 10) || CASE item_id % 3 WHEN 0 THEN '' ELSE '-' || (item_id % 3) END AS question FROM benchmark"

#: SQL, for Spark and others alike, of a model's answer about a document: rows (doc_id, source, lang, quality).
_PURE = """concat('{"entities":[{"name":" ', coalesce(source, 'none'), '  Org","type":"organisation","aliases":["', coalesce(lang, 'xx'), '",""," "],"evidence_excerpt":"e', cast(doc_id % 7 AS string), '"},{"name":"Topic ', cast(doc_id % 13 AS string), '"},{"name":"","type":"person"},{"name":0},{"name":"P', cast(doc_id % 5 AS string), '","type":"militaryUnit","aliases":"none"}],"dates":[{"label":"l","value":"20', cast(10 + doc_id % 9 AS string), '","certainty":', cast(coalesce(quality, 0) AS string), '},{"label":"x","value":""}],"relationships":[{"source_entity":"Topic ', cast(doc_id % 13 AS string), '","target_entity":"topic ', cast((doc_id + 1) % 13 AS string), '","relation_type":"near","evidence_excerpt":"r"},{"source_entity":"Topic ', cast(doc_id % 13 AS string), '","target_entity":"', coalesce(source, 'none'), ' Org","target_type":"org","relation_type":""},{"source_entity":"P1","target_entity":"Topic 1"}],"significance":"About ', cast(doc_id % 17 AS string), '"}')"""
RESPONSE = f"""CASE doc_id % 8 WHEN 0 THEN {_PURE} WHEN 1 THEN concat('Here it is: ```json ', {_PURE}, ' ``` as asked') WHEN 2 THEN concat('Sure. ', {_PURE}, ' Done.') WHEN 3 THEN concat('```json ', {_PURE}) WHEN 4 THEN 'no braces here' WHEN 5 THEN '{{bad' WHEN 6 THEN '{{''entities'': []}}' ELSE concat('{{"entities":["text",{{"name":"', coalesce(source, 'none'), '"}}],"dates":"none","relationships":[1],"significance":true}}') END"""


def _field(e: str, name: str) -> str:
    kind, text = f"json_type({e}, '$.{name}')", f"json_extract_string({e}, '$.{name}')"
    return _clean(f"CASE {kind} WHEN 'VARCHAR' THEN {text} WHEN 'BOOLEAN' THEN CASE WHEN {text} = 'true' THEN 'True' END ELSE CASE WHEN try_cast({text} AS DOUBLE) = 0 THEN '' ELSE {text} END END")


def _type(x: str) -> str:
    return f"CASE WHEN lower({x}) IN ('', 'concept') THEN 'Concept' WHEN lower({x}) IN ('date', 'time') THEN 'Date' WHEN lower({x}) IN ('location', 'place') THEN 'Location' WHEN lower({x}) IN ('org', 'organization', 'organisation') THEN 'Organization' WHEN lower({x}) IN ('person', 'people') THEN 'Person' ELSE upper({x}[1]) || {x}[2:] END"


def _id(kind: str, name: str) -> str:
    return f"substr(sha256(doc_id || '|' || {kind} || '|' || lower({name})), 1, 16)"


def _elements(path: str) -> str:
    return f"(SELECT * FROM (SELECT chunk_id, doc_id, unnest(json_extract(v, '$.{path}[*]')) AS e, generate_subscripts(json_extract(v, '$.{path}[*]'), 1) AS place FROM said WHERE json_type(v, '$.{path}') = 'ARRAY') WHERE json_type(e) = 'OBJECT')"


_SAID = f"""said AS (SELECT chunk_id, doc_id, v FROM (SELECT chunk_id, doc_id, coalesce(try_cast(nullif(regexp_extract(response, '(?s)```json\\s*(\\{{.*?\\}})\\s*```', 1), '') AS JSON), try_cast(nullif(regexp_extract(response, '(?s)(\\{{.*\\}})', 1), '') AS JSON)) AS v
  FROM (SELECT doc_id AS chunk_id, (doc_id % 50)::VARCHAR AS doc_id, {RESPONSE} AS response FROM documents JOIN (SELECT DISTINCT doc_id, quality FROM labels) USING (doc_id))) WHERE v IS NOT NULL),
ent AS (SELECT *, {_id("type", "name")} AS id FROM (SELECT chunk_id, doc_id, place, {_field("e", "name")} AS name, {_type("(" + _field("e", "type") + ")")} AS type, CASE WHEN json_type(e, '$.aliases') = 'ARRAY' THEN array_to_string(list_filter(list_transform(json_extract_string(e, '$.aliases[*]'), lambda a: {_clean("a")}), lambda a: a <> ''), ',') ELSE '' END AS aliases, {_field("e", "evidence_excerpt")} AS evidence_excerpt FROM {_elements("entities")}) WHERE name <> ''),
dat AS (SELECT *, {_id("'Date'", "value")} AS id FROM (SELECT chunk_id, doc_id, place, {_field("e", "value")} AS value, {_field("e", "label")} AS label, {_field("e", "certainty")} AS certainty FROM {_elements("dates")}) WHERE value <> ''),
nodes AS (SELECT id, name, type, aliases, source_doc_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY chunk_id DESC, turn DESC, place DESC) AS k FROM (
  SELECT id, name, type, aliases, doc_id AS source_doc_id, chunk_id, 0 AS turn, place FROM ent UNION ALL SELECT id, value, 'Date', '', doc_id, chunk_id, 1, place FROM dat)) WHERE k = 1)"""

_LINE_CHUNKS = "lines AS (SELECT l_orderkey * 10 + l_linenumber AS chunk_id, CASE WHEN min(l_tax) >= 0.02 THEN l_orderkey END AS section_id, l_linenumber AS chunk_index, l_linenumber * 1500 AS start_char, min(l_suppkey) AS q_id, max(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def _expanded(by: str, reach: int) -> str:
    return f"SELECT '{by}' AS by, q_id, chunk_id, min(rank)::INT AS seed_rank FROM (SELECT h.q_id, c.chunk_id, h.chunk_index AS rank FROM lines h JOIN lines c ON h.section_id = c.section_id AND c.{by} BETWEEN h.{by} - {reach} AND h.{by} + {reach} WHERE h.quantity >= 45 UNION ALL SELECT q_id, chunk_id, chunk_index FROM lines WHERE quantity >= 45) GROUP BY q_id, chunk_id"


_HYDRATED = """hydrated AS (SELECT o_custkey AS q_id, o_orderkey AS chunk_id, coalesce(CASE WHEN n_nationkey % 4 > 0 THEN n_name END, '') AS doc_title, coalesce('6000-' || n_regionkey, '') AS ref_number,
  CASE WHEN o_orderkey % 3 = 0 THEN 'own' ELSE coalesce(CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END, o_orderpriority, '') END AS section_title, o_orderpriority
  FROM orders LEFT JOIN customer ON o_orderkey % 7 > 0 AND c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey)"""
_CONTEXT = f"""WITH {_HYDRATED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY chunk_id) AS rank FROM hydrated),
blocks AS (SELECT q_id, rank, chunk_id, concat_ws(' — ', CASE WHEN doc_title <> '' THEN doc_title WHEN ref_number <> '' THEN 'Order ' || ref_number END, CASE WHEN section_title <> '' THEN 'Section: ' || section_title END) AS header, {_clean("CASE WHEN chunk_id % 5 > 0 THEN repeat(o_orderpriority || ' ', 5) END")} AS t FROM ranked WHERE rank <= 3)
SELECT q_id, {_strip("string_agg(CASE WHEN header = '' THEN 'Context' ELSE header END || chr(10) || '[chunk_id=' || chunk_id || ']' || chr(10) || CASE WHEN length(t) > 40 THEN regexp_replace(substr(t, 1, 40), '\\s+$', '') ELSE t END || chr(10), chr(10) ORDER BY rank)")} AS context FROM blocks WHERE t <> '' GROUP BY q_id"""

_COMPACT = "concat_ws(' ', CASE WHEN ref_base IS NOT NULL THEN 'Order' END, coalesce(ref_full, ref_base), CASE WHEN len(k) > 0 THEN array_to_string(k, ' ') ELSE original_question END)"
_TITLE = _PLAIN.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
_TURN_BASE, _TURN_FULL = _number("original_question")
_REF_BASE, _REF_FULL = _number("question")
_BLANK = f"{_strip('coalesce(text, chr(32))')} = ''"

ORACLES = {
    "sections_flatten": f"SELECT doc_id, section_index::INT AS section_index, doc_id || ':s' || CASE WHEN section_index < 1000 THEN lpad(section_index::VARCHAR, 3, '0') ELSE section_index::VARCHAR END AS section_id, {_N_TOKENS.format('text')} FROM ({_LINES}) WHERE trim(text) <> ''",
    "chunk_spans": _SPAN_ROWS,
    "incremental_chunks": _SPAN_ROWS,
    "keyed_upserts": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey",
    "graph_load": f"SELECT doc_id, count(*) AS n_links FROM ({_LINES}) WHERE trim(text) <> '' AND ((doc_id % 2 = 0) OR (doc_id % 2 = 1 AND doc_id % 5 > 0)) GROUP BY doc_id",
    "corpus_statistics": r"WITH split AS (SELECT list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents) SELECT term, count(*) AS df, 0::BIGINT AS total FROM (SELECT unnest(list_distinct(t)) AS term FROM split) GROUP BY term UNION ALL SELECT '', count(*), sum(len(t))::BIGINT FROM split",
    "backlog_commits": "SELECT doc_id AS chunk_id, length(text)::INT AS size, CASE WHEN toxic = 1 THEN 'retried' ELSE 'second' END AS run FROM documents JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)",
    "question_keywords": f"SELECT q_id, array_to_string({_keywords('question')}, ' ') AS words FROM ({_ITEMS})",
    "question_rewrite": f"SELECT conv_id, turn, original_question, {_clean(_COMPACT)} AS clean_query, ref_base, ref_full, array_to_string(k, ' ') AS keywords FROM (SELECT *, {_TURN_BASE} AS ref_base, {_TURN_FULL} AS ref_full, {_keywords('original_question')} AS k FROM (SELECT conv_id, turn, {_clean('question')} AS original_question FROM ({_TURN})))",
    "ref_filter": f"WITH {_asked(_REF_ITEMS)}, {_bm25(name='every')}, refs AS (SELECT q_id, {_REF_BASE} AS base, {_REF_FULL} AS full_ref FROM ({_REF_ITEMS})), meta AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 > 0 THEN '600' || (doc_id % 10) || '-' || (doc_id % 3) ELSE '' END AS number, coalesce(source, '') || CASE WHEN doc_id % 3 = 0 THEN ' 600' || (doc_id % 10) ELSE '' END AS title FROM documents) SELECT q_id, chunk_id, score, rank FROM (SELECT q_id, chunk_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id)::INT AS rank FROM scored JOIN refs USING (q_id) JOIN meta USING (chunk_id) WHERE CASE WHEN full_ref IS NOT NULL THEN number = full_ref OR contains(title, full_ref) WHEN base IS NOT NULL THEN starts_with(number, base || '-') OR contains(title, base) ELSE true END) WHERE rank <= 60",
    "answers": _ANSWERS,
    "bm25_topk": f"WITH {_asked()}, {_bm25()} SELECT q_id, chunk_id, score, rank::INT AS rank FROM ft WHERE rank <= 60",
    "keyword_rank": f"WITH {_PARTS}, {_asked()}, {_bm25()}, {_KEYWORD} SELECT * FROM keyword WHERE rank <= 8",
    "titled_ranking": f"WITH parts AS (SELECT doc_id AS chunk_id, concat_ws(' ', coalesce(substr(item, 1, 80), ''), '6' || lpad((doc_id % 1000)::VARCHAR, 3, '0'), coalesce(lang, ''), coalesce(text, '')) AS text FROM documents LEFT JOIN (SELECT item_id, min(text) AS item FROM benchmark GROUP BY item_id) ON item_id = doc_id % 50), {_asked()}, {_bm25()}, {_KEYWORD} SELECT * FROM keyword WHERE rank <= 8",
    "title_rules": r"""SELECT doc_id, trim(regexp_replace(trim(' ' || (doc_id % 12) || ['. ', ')', ' - ', ':', '.1 ', ' '][doc_id % 6 + 1] || coalesce(source, '')), '^\s*\d+\s*[.)\-:]\s*', '')) AS title,
nullif(CASE doc_id % 4 WHEN 0 THEN trim(lang) WHEN 1 THEN '' WHEN 2 THEN '(' || lang ELSE trim(lang) END, '') AS state, CASE WHEN doc_id % 3 < 2 THEN coalesce(source, '') ELSE coalesce(source, '') || '.' END AS cut FROM documents""",
    "vector_topk": f"WITH {_VEC} SELECT q_id, chunk_id, score, rank::INT AS rank FROM vec WHERE rank <= 25",
    "rrf_fusion": f"WITH {_PARTS}, {_asked()}, {_bm25()}, {_VEC} {_RRF}",
    "additive_fusion": f"WITH {_asked(whole=True)}, {_bm25()}, {_VEC} {_ADDITIVE}",
    "minmax_fusion": f"WITH {_asked(whole=True)}, {_bm25()}, {_VEC} {_MINMAX}",
    "all_rankers_overlap": f"""SELECT q_id, chunk_id, string_agg(retriever, ',' ORDER BY retriever) AS retrievers, min(rank)::INT AS best_rank FROM (
SELECT 'keyword' AS retriever, q_id, chunk_id, rank FROM (WITH {_PARTS}, {_asked()}, {_bm25()}, {_KEYWORD} SELECT * FROM keyword WHERE rank <= 8)
UNION ALL SELECT 'rrf', q_id, chunk_id, rank FROM (WITH {_PARTS}, {_asked()}, {_bm25()}, {_VEC} {_RRF})
UNION ALL SELECT 'additive', q_id, chunk_id, rank FROM (WITH {_asked(whole=True)}, {_bm25()}, {_VEC} {_ADDITIVE})
UNION ALL SELECT 'minmax', q_id, chunk_id, rank FROM (WITH {_asked(whole=True)}, {_bm25()}, {_VEC} {_MINMAX})) GROUP BY q_id, chunk_id""",
    "entity_rank": f"""WITH q AS (SELECT q_id, {_keywords("question", 12)} AS words FROM (SELECT min(p_partkey) AS q_id, p_name || ' ' || replace(min(p_brand), '#', '') AS question FROM part GROUP BY p_name)),
hit AS (SELECT q_id, p_partkey AS entity_id, p_name AS name, len(list_filter(words, lambda w: contains(lower(p_name), w) OR contains(lower(p_brand), w))) AS entity_score FROM part, q),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY entity_score DESC, entity_id) AS k FROM hit WHERE entity_score > 0) WHERE k <= 20),
met AS (SELECT q_id, chunk_id, sum(entity_score) AS entity_score, array_to_string(list_slice(list_sort(list(name)), 1, 10), ',') AS matched FROM best JOIN (SELECT DISTINCT l_orderkey AS chunk_id, l_partkey AS entity_id FROM lineitem) USING (entity_id) GROUP BY q_id, chunk_id),
scored AS (SELECT q_id, chunk_id, entity_score::BIGINT AS entity_score, len(list_filter(words, lambda w: contains(lower('small red ' || o_orderpriority || ' brand'), w)))::BIGINT AS hit_bonus, matched FROM met JOIN orders ON o_orderkey = chunk_id JOIN q USING (q_id))
SELECT * FROM (SELECT q_id, chunk_id, 10 * entity_score + hit_bonus AS score, entity_score, hit_bonus, matched, row_number() OVER (PARTITION BY q_id ORDER BY 10 * entity_score + hit_bonus DESC, chunk_id)::INT AS rank FROM scored) WHERE rank <= 8""",
    "sibling_expand": f"WITH {_LINE_CHUNKS} {_expanded('start_char', 4000)} UNION ALL {_expanded('chunk_index', 1)}",
    "sibling_window": f"WITH {_LINE_CHUNKS} SELECT chunk_id, array_to_string(list_sort(list(chunk_id) OVER (PARTITION BY section_id ORDER BY chunk_index RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)), ',') AS siblings FROM lines WHERE section_id IS NOT NULL UNION ALL SELECT chunk_id, chunk_id::VARCHAR FROM lines WHERE section_id IS NULL",
    "hydrate_meta": f"WITH {_HYDRATED} SELECT q_id, chunk_id, doc_title, ref_number, section_title FROM hydrated",
    "context_build": _CONTEXT,
    "prompt_render": f"SELECT q_id, 'Context:' || chr(10) || context || chr(10) || 'Question: ' || q_id || chr(10) AS prompt FROM ({_CONTEXT})",
    "catalog_merge": f"WITH {_KNOWN} SELECT * FROM catalog",
    "catalog_status": f"WITH {_KNOWN} SELECT id, url, coalesce(new_status, CASE WHEN lower(trim(state)) = 'cancelled' THEN 'skipped' ELSE 'pending' END) AS status, state FROM catalog LEFT JOIN (SELECT trim(url) AS url, arg_max(CASE WHEN page_id % 2 = 0 THEN 'parsed' ELSE 'skipped' END, page_id) AS new_status FROM pages WHERE page_id % 3 = 1 GROUP BY trim(url)) USING (url)",
    "page_meta": f"SELECT substr(sha256(url), 1, 16) AS id, url, url AS canonical_url, regexp_extract(url, '://([^/?#]*)', 1) AS domain, nullif(trim({_TITLE}), '') AS title, NULL::VARCHAR AS author, nullif(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1), '') AS language, 0 AS n_subjects, 0 AS n_sections, sha256('') AS hash FROM pages",
    "page_latest": "SELECT substr(sha256(url), 1, 16) AS id, url, regexp_extract(url, '://([^/?#]*)', 1) AS domain FROM pages GROUP BY url",
    "page_links": f"WITH {_LINKS} SELECT page, url, min(place)::INT AS place FROM firsts GROUP BY page, url",
    "link_first_seen": f"WITH {_LINKS} SELECT DISTINCT url, NULL::VARCHAR AS state FROM firsts",
    "doc_latest": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "doc_hash_dupes": f"SELECT hash, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_strip('x')}), lambda x: x <> ''), ' ')) AS hash FROM documents) GROUP BY hash HAVING count(*) > 1",
    "key_violations": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "link_integrity": "SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)",
    "model_json_entities": f"WITH {_SAID} SELECT * FROM nodes",
    "extraction_loop": f"WITH {_SAID} SELECT * FROM nodes",
    "model_json_mentions": f"WITH {_SAID} SELECT chunk_id, entity_id, evidence_excerpt FROM (SELECT chunk_id, id AS entity_id, evidence_excerpt, row_number() OVER (PARTITION BY chunk_id, id ORDER BY place DESC) AS k FROM ent) WHERE k = 1",
    "model_json_dates": f"WITH {_SAID} SELECT chunk_id, entity_id, label, certainty FROM (SELECT chunk_id, id AS entity_id, label, certainty, row_number() OVER (PARTITION BY chunk_id, id ORDER BY place DESC) AS k FROM dat) WHERE k = 1",
    "model_json_relations": f"""WITH {_SAID}, ends AS (SELECT chunk_id, place, {_id(_type("st"), "s")} AS source_id, {_id(_type("tt"), "t")} AS target_id, CASE WHEN relation_type = '' THEN 'RELATED_TO' ELSE relation_type END AS relation_type, evidence_excerpt FROM (
SELECT chunk_id, doc_id, place, {_field("e", "source_entity")} AS s, {_field("e", "target_entity")} AS t, {_field("e", "source_type")} AS st, {_field("e", "target_type")} AS tt, {_field("e", "relation_type")} AS relation_type, {_field("e", "evidence_excerpt")} AS evidence_excerpt FROM {_elements("relationships")}) WHERE s <> '' AND t <> '')
SELECT source_id, target_id, relation_type, evidence_excerpt FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, relation_type ORDER BY chunk_id DESC, place DESC) AS k FROM ends WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)) WHERE k = 1""",
    "extraction_written": f"WITH {_SAID} SELECT d.doc_id AS chunk_id, CASE WHEN v IS NOT NULL THEN {_field('v', 'significance')} END AS significance, CASE WHEN v IS NOT NULL THEN 'model-a' END AS extract_model, CASE WHEN v IS NOT NULL THEN '2024-01-01T00:00:00Z' END AS extracted_at FROM documents d LEFT JOIN (SELECT chunk_id, any_value(v) AS v FROM said GROUP BY chunk_id) s ON s.chunk_id = d.doc_id",
    "embed_backlog": f"SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE len(embedding) > 0) AND NOT {_BLANK}",
    "extract_backlog": "SELECT doc_id AS chunk_id, doc_id % 97 % 10 AS doc_id FROM documents WHERE doc_id % 11 > 0 AND doc_id % 97 % 10 % 2 = 1 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "embed_hook": f"SELECT doc_id AS chunk_id, CASE WHEN vec_id IS NOT NULL THEN len(embedding)::INT WHEN NOT {_BLANK} THEN 2 END AS size, CASE WHEN vec_id IS NOT NULL THEN embedding[1]::DOUBLE WHEN NOT {_BLANK} THEN length(text)::DOUBLE END AS first, CASE WHEN vec_id IS NULL AND NOT {_BLANK} THEN 'lengths' END AS embedding_model, CASE WHEN vec_id IS NULL AND NOT {_BLANK} THEN '2024-01-01T00:00:00Z' END AS embedded_at FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
    "generate_hook": f"SELECT doc_id AS chunk_id, CASE WHEN {_BLANK} THEN '{{}}' WHEN n % 5 > 0 THEN '{{\"significance\": \"' || n || '\"}}' ELSE 'no' END AS response, CASE WHEN {_BLANK} THEN 0 WHEN n % 5 > 0 THEN 1 ELSE 3 END AS attempts, CASE WHEN {_BLANK} OR n % 5 > 0 THEN 'ok' ELSE 'bad_json' END AS status FROM (SELECT doc_id, text, length('Text: ' || coalesce(text, '')) AS n FROM documents)",
    "ingest_counts": f"WITH RECURSIVE {_spans(_LINES)} SELECT 'docs' AS what, count(*) AS n FROM documents UNION ALL SELECT 'sections', count(*) FROM secs UNION ALL SELECT 'chunks', count(*) FROM spans UNION ALL SELECT 'links', count(*) FROM (SELECT DISTINCT doc_id, section_index, chunk_id FROM spans)",
    "props_json": f"SELECT event_id, {_field('props', 'k')} AS k, '' AS \"none\" FROM events",
}
