"""DuckDB SQL for the registered queries, with the same derivations of inputs."""

from __future__ import annotations

from doctree_spark.jobs.derived import EXAMPLES
from doctree_spark.jobs.standins import BROKEN, WORDS
from doctree_spark.operators.chunk import EMPTY
from doctree_spark.operators.classify import RULES, VERSUS
from doctree_spark.operators.context import NO_RESULT, REASONS, REFUSAL
from doctree_spark.operators.library import NO_CHUNKS

#: Limits of the queries that ask from text to prompt; their questions are far from chunks.
ASK_LAYER, ASK_RELEVANCE, ASK_INSUFFICIENT = 0.02, 0.05, 0.12
TOKEN = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"


def _tokens(text: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '{TOKEN}')) AS INTEGER)"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def _sentences(text: str) -> str:
    cut = f"string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {_strip('s')}), lambda s: s <> '')"


def _shortened(text: str, most: int = 800) -> str:
    flat = _strip(f"regexp_replace({text}, '\\s+', ' ', 'g')")
    head = f"substr({flat}, 1, {most})"
    back = f"instr(reverse({head}), ' .')"
    return f"""CASE WHEN {flat} = '' THEN 'No content to summarize.' WHEN length({flat}) <= {most} THEN {flat}
      WHEN {back} > 0 THEN {_strip(f"substr({head}, 1, {most} - 1 - {back})")} || '...' ELSE {_strip(head)} || '...' END"""


UPLOADS = """uploads AS (
  SELECT doc_id, source || '_' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt' WHEN 2 THEN '.md' ELSE '.docx' END AS filename,
         substr(sha256(text), 1, 16) AS document_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS upload_time FROM documents),
firsts AS (SELECT document_id, arg_min(filename, (upload_time, filename)) AS filename, min(upload_time) AS upload_time, count(*) AS uploads FROM uploads GROUP BY document_id),
catalog AS (SELECT document_id, arg_min(filename, doc_id) AS filename, CASE WHEN min(doc_id) % 9 = 0 THEN 'failed: x' ELSE 'completed' END AS status, min(upload_time) AS upload_time
  FROM uploads WHERE doc_id % 3 = 0 GROUP BY document_id)"""

BLOCKS = """lines AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_no FROM documents),
blocks AS (SELECT document_id, block_no // 40 AS page_no, block_no, 612.0::DOUBLE * ((block_no * 37) % 100) / 100 AS x0, CASE WHEN block_no % 11 = 10 THEN 1 ELSE 0 END AS block_type, text FROM lines)"""


def _body(where: str, margin: float) -> str:
    good = f"block_type = 0 AND x0 < {margin} * 612.0 AND {_strip('text')} <> ''"
    return f"""bodies AS (SELECT document_id, coalesce(string_agg({_strip('text')}, chr(10) || chr(10) ORDER BY page_no, block_no) FILTER ({good}), '') AS text,
  count(*) FILTER ({good}) AS kept, count(*) FILTER (NOT ({good})) AS dropped FROM blocks {where} GROUP BY document_id)"""


SECTIONED = """sectioned AS (SELECT doc_id AS document_id, CASE WHEN doc_id % 2 = 0 THEN 'Part ' || lang || chr(10) || chr(10) ELSE '' END || replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)"""

SECTIONS = f"""{SECTIONED},
raw AS (SELECT document_id, text AS whole, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM sectioned),
bare AS (SELECT *, {_strip('line')} AS b FROM raw),
near AS (SELECT *, lag(b) OVER w AS before, lead(b) OVER w AS behind FROM bare WINDOW w AS (PARTITION BY document_id ORDER BY i)),
flagged AS (SELECT *, CASE WHEN b <> '' AND length(b) < 60 AND NOT regexp_matches(b, '[.,]$') AND NOT regexp_matches(b, '^(Figure|Table|\\p{{N}})') AND regexp_matches(b, '[\\p{{L}}\\p{{N}}]')
   AND (coalesce(before = '', false) OR coalesce(behind = '', false)) THEN 1 ELSE 0 END AS head FROM near),
counted AS (SELECT *, sum(head) OVER (PARTITION BY document_id ORDER BY i) AS no, sum(head) OVER (PARTITION BY document_id) AS heads FROM flagged),
joined AS (SELECT document_id, no, any_value(heads) AS heads, any_value(whole) AS whole, {_strip("string_agg(line, chr(10) ORDER BY i)")} AS text FROM counted GROUP BY document_id, no),
kept_sections AS (SELECT document_id, no, text FROM joined WHERE heads > 0 AND text <> '' UNION ALL SELECT document_id, 0, whole FROM joined WHERE heads = 0),
sections AS (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY no) - 1 AS INTEGER) AS section_no, text FROM kept_sections)"""

#: A chunk's number from the running budget, by a recursion over the sentences of all documents at a time.
CHUNKS = f"""{SECTIONS},
listed AS (SELECT document_id, section_no, {_sentences('text')} AS s FROM sections),
sents AS (SELECT document_id, section_no, unnest(s) AS text, generate_subscripts(s, 1) AS k FROM listed),
numbered AS (SELECT document_id, section_no, text, {_tokens('text')} AS t, row_number() OVER (PARTITION BY document_id ORDER BY section_no, k) AS i FROM sents),
walk AS (
  SELECT document_id, i, section_no, t, 0 AS no, CASE WHEN t > 100 THEN -1 ELSE t END AS used FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.document_id, n.i, n.section_no, n.t,
    w.no + CASE WHEN n.t > 100 OR w.used < 0 OR w.used + n.t > 100 OR w.section_no <> n.section_no THEN 1 ELSE 0 END,
    CASE WHEN n.t > 100 THEN -1 WHEN w.used < 0 OR w.used + n.t > 100 OR w.section_no <> n.section_no THEN n.t ELSE w.used + n.t END
  FROM walk w JOIN numbered n ON n.document_id = w.document_id AND n.i = w.i + 1),
made AS (SELECT w.document_id, w.no, min(w.section_no) AS section_no, string_agg(n.text, ' ' ORDER BY w.i) AS text FROM walk w JOIN numbered n USING (document_id, i) GROUP BY w.document_id, w.no),
chunks AS (SELECT *, {_tokens('text')} AS token_count FROM made)"""


#: The same with other tokens and sentences: quarters of lengths, parts between commas.
CHUNKS_PLUGGED = CHUNKS.replace(_tokens("text"), "CAST((length(text) + 3) // 4 AS INTEGER)").replace(_sentences("text"), f"list_filter(list_transform(string_split(text, ','), lambda s: {_strip('s')}), lambda s: s <> '')")


def _embedded(name: str, source: str, key: str) -> str:
    """CTE ``name``: key, place (0-63), v from ``source`` with key and text."""
    return f"""{name}_t AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS t FROM {source}),
{name}_h AS (SELECT {key}, md5(t) AS h, count(*) AS n FROM {name}_t GROUP BY ALL),
{name}_s AS (SELECT {key}, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 64 AS place, sum(n * CASE WHEN CAST('0x' || substr(h, 9, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS s FROM {name}_h GROUP BY ALL),
{name} AS (SELECT {key}, place, s / nullif(sqrt(sum(s * s) OVER (PARTITION BY {key})), 0) AS v FROM {name}_s)"""


def _vectors(name: str, source: str, key: str) -> str:
    """CTE ``name``: key and e, the 64 numbers of each text in ``source``, all 0 without tokens."""
    return f"""{_embedded(f'{name}_v', source, key)},
{name} AS MATERIALIZED (SELECT {key}, list(coalesce(v, 0) ORDER BY g.place) AS e FROM (SELECT DISTINCT {key} FROM {source}) CROSS JOIN (SELECT unnest(range(64)) AS place) g LEFT JOIN {name}_v USING ({key}, place) GROUP BY {key})"""


NODES = f"""{CHUNKS},
leaf_text AS MATERIALIZED (SELECT 'd' || document_id AS document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY no) - 1 AS INTEGER) AS node_id, text FROM chunks WHERE token_count >= 40),
leaf_key AS (SELECT (document_id, node_id) AS key, text FROM leaf_text), {_vectors('leaf_e', 'leaf_key', 'key')},
leaf AS MATERIALIZED (SELECT document_id, node_id, e, text FROM leaf_text JOIN leaf_e ON key = (document_id, node_id)),
sizes AS (SELECT document_id, CAST(count(*) AS INTEGER) AS n, CAST(ceil(count(*) / 4.0) AS INTEGER) AS p FROM leaf GROUP BY document_id),
member AS (SELECT document_id, node_id, node_id // 4 AS cluster FROM leaf UNION ALL
  SELECT document_id, node_id, node_id // 4 + 1 FROM leaf JOIN sizes USING (document_id) WHERE node_id % 8 = 3 AND node_id // 4 + 1 < p),
sum1 AS (SELECT document_id, cluster, list(node_id ORDER BY node_id) AS children, string_agg(text, chr(10) || chr(10) ORDER BY node_id) AS texts FROM member JOIN leaf USING (document_id, node_id) GROUP BY ALL),
vec1 AS (SELECT document_id, cluster, d, sum(x) AS x FROM (SELECT m.document_id, m.cluster, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM member m JOIN leaf USING (document_id, node_id)) GROUP BY ALL),
dir1 AS (SELECT document_id, cluster, list(x ORDER BY d) AS s FROM vec1 GROUP BY ALL),
layer1 AS MATERIALIZED (SELECT document_id, n + cluster AS node_id, cluster, {_shortened('texts')} AS text, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS e, children FROM sum1 JOIN dir1 USING (document_id, cluster) JOIN sizes USING (document_id)),
sum2 AS (SELECT document_id, cluster // 4 AS cluster, list(node_id ORDER BY node_id) AS children, string_agg(text, chr(10) || chr(10) ORDER BY node_id) AS texts FROM layer1 GROUP BY ALL),
vec2 AS (SELECT document_id, cluster, d, sum(x) AS x FROM (SELECT document_id, cluster // 4 AS cluster, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM layer1) GROUP BY ALL),
dir2 AS (SELECT document_id, cluster, list(x ORDER BY d) AS s FROM vec2 GROUP BY ALL),
layer2 AS (SELECT document_id, n + p + cluster AS node_id, {_shortened('texts')} AS text, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS e, children FROM sum2 JOIN dir2 USING (document_id, cluster) JOIN sizes USING (document_id)),
nodes AS MATERIALIZED (SELECT *, {_tokens('text')} AS token_count FROM (
  SELECT document_id, node_id, 0 AS layer, text, e, CAST([] AS INTEGER[]) AS children FROM leaf UNION ALL
  SELECT document_id, node_id, 1, text, e, children FROM layer1 UNION ALL SELECT document_id, node_id, 2, text, e, children FROM layer2))"""

FOREST = f"""{NODES},
asked0 AS (SELECT l.document_id, l.node_id, list_transform(list_zip(l.e, o.e), lambda z: 0.8 * z[1] + 0.6 * z[2]) AS s
  FROM leaf l JOIN sizes USING (document_id) JOIN leaf o ON o.document_id = l.document_id AND o.node_id = (l.node_id + 1) % n WHERE l.node_id % 5 = 0),
asked AS MATERIALIZED (SELECT document_id || '_' || node_id AS query_id, document_id, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS q FROM asked0),
scored AS MATERIALIZED (SELECT query_id, a.document_id, node_id, layer, round(list_dot_product(q, e), 6) AS score, token_count FROM asked a JOIN nodes USING (document_id))"""


def _fill(name: str, source: str, budget: int) -> str:
    """CTE ``name``: the greedy walk over ``source`` by score, node by node, for all queries at a time."""
    return f"""{name}_o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id DESC) AS i FROM {source}),
{name}_w AS (
  SELECT query_id, i, CASE WHEN token_count <= {budget} THEN token_count ELSE 0 END AS used, token_count <= {budget} AS taken FROM {name}_o WHERE i = 1
  UNION ALL
  SELECT o.query_id, o.i, w.used + CASE WHEN w.used + o.token_count <= {budget} THEN o.token_count ELSE 0 END, w.used + o.token_count <= {budget}
  FROM {name}_w w JOIN {name}_o o ON o.query_id = w.query_id AND o.i = w.i + 1),
{name} AS MATERIALIZED (SELECT query_id, document_id, node_id, layer, score, token_count, CAST(row_number() OVER (PARTITION BY query_id ORDER BY i) AS INTEGER) AS rank FROM {name}_o JOIN {name}_w USING (query_id, i) WHERE taken)"""


def _traversal(name: str, asked: str, least: float, scored: str = "scored") -> str:
    """CTE ``name``: three unrolled layers."""
    parts, frontier = [], f"SELECT query_id, document_id, node_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY node_id) AS BIGINT) AS pos FROM {asked} JOIN nodes USING (document_id) WHERE layer = 2"
    for k in range(3):
        parts.append(f"""{name}_s{k} AS (SELECT f.query_id, f.document_id, f.node_id, f.pos, s.layer, s.score, s.token_count, max(s.score) OVER (PARTITION BY f.query_id) AS best
  FROM ({frontier}) f JOIN {scored} s USING (query_id, node_id)),
{name}_c{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos DESC) AS r FROM {name}_s{k} WHERE best >= {least}) WHERE r <= 3)""")
        frontier = f"SELECT query_id, document_id, child AS node_id, r * 4294967296 + place AS pos FROM (SELECT c.query_id, c.document_id, c.r, unnest(n.children) AS child, generate_subscripts(n.children, 1) AS place FROM {name}_c{k} c JOIN nodes n USING (document_id, node_id))"
    union = " UNION ALL ".join(f"SELECT *, {k} AS level FROM {name}_c{k}" for k in range(3))
    return ",\n".join(parts) + f",\n{name} AS MATERIALIZED (SELECT query_id, document_id, node_id, layer, score, token_count, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, level, r) AS INTEGER) AS rank FROM ({union}))"


def _distinct(name: str, source: str, threshold: float) -> str:
    """CTE ``name``: ranks kept by the greedy removal, found rank by rank."""
    return f"""{name}_like AS MATERIALIZED (SELECT a.query_id, a.rank AS early, b.rank AS late FROM {source} a JOIN {source} b ON a.query_id = b.query_id AND a.rank < b.rank
  JOIN nodes x ON x.document_id = a.document_id AND x.node_id = a.node_id JOIN nodes y ON y.document_id = b.document_id AND y.node_id = b.node_id WHERE round(list_dot_product(x.e, y.e), 6) >= {threshold}),
{name}_near AS (SELECT query_id, late AS rank, list(early) AS earlier FROM {name}_like GROUP BY ALL),
{name}_o AS MATERIALIZED (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY s.rank) AS i, coalesce(earlier, CAST([] AS INTEGER[])) AS earlier FROM {source} s LEFT JOIN {name}_near USING (query_id, rank)),
{name}_w AS (SELECT query_id, i, [rank] AS kept FROM {name}_o WHERE i = 1 UNION ALL
  SELECT o.query_id, o.i, CASE WHEN list_has_any(w.kept, o.earlier) THEN w.kept ELSE list_append(w.kept, o.rank) END FROM {name}_w w JOIN {name}_o o ON o.query_id = w.query_id AND o.i = w.i + 1),
{name}_last AS (SELECT query_id, arg_max(kept, i) AS kept FROM {name}_w GROUP BY query_id),
{name} AS (SELECT s.query_id, document_id, node_id, layer, score, token_count, CAST(list_position(kept, rank) AS INTEGER) AS rank FROM {source} s JOIN {name}_last l USING (query_id) WHERE list_contains(kept, rank))"""


def _in_scope(name: str, source: str, least: float) -> str:
    return f"{name} AS MATERIALIZED (SELECT * EXCLUDE (best) FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM {source}) WHERE best >= {least})"


_W = "coalesce(string_split(text, ' ')[{}], '')"
QUESTIONS = f"""questions AS (SELECT conv_id || '_' || turn AS query_id, conv_id, text AS said, CASE conv_id % 8 WHEN 0 THEN 'what is ' || w1 WHEN 1 THEN 'what are the main ' || w1
  WHEN 2 THEN 'compare ' || w1 || ' ' || w2 || ' and ' || w2 WHEN 3 THEN 'how do ' || w1 || ' and ' || w2 || ' ' || w1 || ' differ?' WHEN 4 THEN w1 || ' vs ' || w2
  WHEN 5 THEN 'why ' || w1 WHEN 6 THEN 'collapsed: define ' || w1 ELSE w1 || ' ' || w2 END AS query
  FROM (SELECT conv_id, turn, text, {_W.format(1)} AS w1, {_W.format(2)} AS w2 FROM conversations WHERE role = 'user'))"""
#: The same of every document, about its own first two words; ``conv_id`` is the document's number.
ASKED_QUESTIONS = QUESTIONS.replace(f"{_W.format(1)} AS w1, {_W.format(2)} AS w2 FROM conversations WHERE role = 'user'", "coalesce(ws[1], '') AS w1, coalesce(ws[2], '') AS w2 FROM (SELECT doc_id AS conv_id, 0 AS turn, text, regexp_extract_all(text, '\\p{L}+') AS ws FROM documents)")
_CLEAN = "regexp_replace(" + _strip("lower(query)") + ", '\\?+$', '')"
_RULE = "CASE " + " ".join(f"WHEN regexp_matches({_CLEAN}, '{p}') THEN '{name}'" for p, name in RULES) + " END"
_PREFIXED = f"""prefixed AS (SELECT query_id, conv_id, said, nullif(lower(regexp_extract({_strip('query')}, '(?i)^(collapsed|traversal):', 1)), '') AS override,
  {_strip(f"regexp_replace({_strip('query')}, '(?i)^(collapsed|traversal):', '')")} AS query FROM questions)"""
_EX = ", ".join(f"({k}, '{t}', '{label}')" for k, (t, label) in enumerate(EXAMPLES))
EXAMPLES_SQL = f"""examples AS (SELECT * FROM (VALUES {_EX}) AS v(example_id, text, label)), {_embedded('ex', 'examples', 'example_id')}"""


def _nearest(source: str) -> str:
    return f"""asked_text AS (SELECT query_id, query AS text FROM {source}), {_embedded('qe', 'asked_text', 'query_id')}, {EXAMPLES_SQL},
near_s AS (SELECT q.query_id, e.example_id, round(sum(q.v * e.v), 6) AS score FROM qe q JOIN ex e USING (place) GROUP BY ALL),
near_a AS (SELECT t.query_id, e.example_id, coalesce(n.score, 0) AS score, label FROM asked_text t CROSS JOIN examples e LEFT JOIN near_s n ON n.query_id = t.query_id AND n.example_id = e.example_id),
nearest AS (SELECT query_id, label, score AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, example_id) AS r FROM near_a) WHERE r = 1)"""


CLASSIFIED = f"""{QUESTIONS}, {_PREFIXED}, {_nearest('prefixed')},
ruled AS (SELECT *, CASE WHEN override IS NULL THEN {_RULE} END AS rule FROM prefixed WHERE query <> ''),
classified AS (SELECT r.query_id, r.conv_id, r.said, r.query, override, CASE WHEN override IS NOT NULL THEN 'override' ELSE coalesce(rule, CASE WHEN confidence < 0.45 THEN 'specific' ELSE label END) END AS query_type,
  CASE WHEN override IS NOT NULL OR rule IS NOT NULL THEN 1.0::DOUBLE ELSE confidence END AS confidence FROM ruled r JOIN nearest USING (query_id))"""

_LEAVES = "members AS (SELECT document_id, cluster, node_id, text, " + _tokens("text") + " AS t FROM member JOIN leaf USING (document_id, node_id))"


def _context(budget: int) -> str:
    """CTE ``contexts``: members in order; the words of the first that doesn't fit, while they do."""
    return f"""{_LEAVES}, run AS (SELECT *, sum(t) OVER (PARTITION BY document_id, cluster ORDER BY node_id) AS upto FROM members),
whole AS (SELECT document_id, cluster, node_id, text FROM run WHERE upto <= {budget}),
first_over AS (SELECT document_id, cluster, min(node_id) AS node_id FROM run WHERE upto > {budget} GROUP BY ALL),
over_words AS (SELECT r.document_id, r.cluster, r.node_id, upto - t AS used, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM run r JOIN first_over USING (document_id, cluster, node_id)),
over_one AS (SELECT document_id, cluster, node_id, used, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM over_words),
over_run AS (SELECT *, used + sum({_tokens('w')}) OVER (PARTITION BY document_id, cluster ORDER BY i) AS upto FROM over_one),
part AS (SELECT document_id, cluster, node_id, string_agg(w, ' ' ORDER BY i) AS text FROM over_run WHERE upto <= {budget} GROUP BY ALL),
taken AS (SELECT * FROM whole UNION ALL SELECT * FROM part),
contexts AS (SELECT document_id, cluster, coalesce(string_agg(t.text, chr(10) || chr(10) ORDER BY t.node_id), '') AS context FROM (SELECT DISTINCT document_id, cluster FROM member) LEFT JOIN taken t USING (document_id, cluster) GROUP BY ALL)"""


_TOP = _fill("found", "scored", 2000)
_SMALL = _fill("found", "scored", 500)
_SEP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
#: Assembly at 500 tokens over ``found``.
_ASSEMBLE = f"""texts AS (SELECT f.query_id, f.layer, f.rank, n.text, {_tokens('n.text')} AS t FROM found f JOIN nodes n USING (document_id, node_id)),
as_o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY layer, rank) AS i FROM texts),
as_w AS (SELECT query_id, i, CASE WHEN t <= 500 THEN t ELSE 0 END AS used, CASE WHEN t <= 500 THEN 1 ELSE 0 END AS n, t <= 500 AS taken FROM as_o WHERE i = 1 UNION ALL
  SELECT o.query_id, o.i, CASE WHEN w.used + o.t + extra <= 500 THEN w.used + o.t + extra ELSE w.used END, CASE WHEN w.used + o.t + extra <= 500 THEN w.n + 1 ELSE w.n END, w.used + o.t + extra <= 500
  FROM (SELECT *, CASE WHEN n > 0 THEN {_tokens(_SEP)} ELSE 0 END AS extra FROM as_w) w JOIN as_o o ON o.query_id = w.query_id AND o.i = w.i + 1),
assembled AS (SELECT query_id, coalesce(string_agg(text, {_SEP} ORDER BY i) FILTER (taken), '') AS context, max(used) AS tokens,
  CAST(count(*) FILTER (taken AND layer = 0) AS INTEGER) AS leaves, CAST(count(*) FILTER (taken AND layer > 0) AS INTEGER) AS summaries, CAST(count(*) FILTER (NOT taken) AS INTEGER) AS dropped FROM as_o JOIN as_w USING (query_id, i) GROUP BY query_id)"""
_FOUND = "query_id, document_id, node_id, layer, score, token_count, rank"


def _best(found: str, threshold: float, asked: str = "asked") -> str:
    return f"flags AS (SELECT f.query_id, max(round(list_dot_product(q, e), 6)) AS best, max(round(list_dot_product(q, e), 6)) < {threshold} AS insufficient FROM {found} f JOIN {asked} a USING (query_id) JOIN nodes n ON n.document_id = f.document_id AND n.node_id = f.node_id GROUP BY f.query_id)"


_STARTS = " OR ".join(f"starts_with(lower(query), '{r}')" for r in REASONS)
_REST = _strip(f"regexp_replace({_strip(f'regexp_extract({_CLEAN}, $$(?:difference between|compare|contrast|how do|how does)\\s+(.+)$$, 1)')}, '\\s+differs?$', '')")


def _ask(c: str) -> str:
    return f"CASE WHEN ends_with(rtrim({c}), 's') THEN 'what are ' || {c} ELSE 'what is ' || {c} END"


def _ws(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"


_LONGER = f"CASE WHEN len({_ws('a')}) < len({_ws('b')}) THEN a || ' ' || array_to_string(list_slice({_ws('b')}, len({_ws('a')}) + 1, len({_ws('b')})), ' ') ELSE a END"



def _decomposed(source: str) -> str:
    """CTE ``subs``: query_id, part, sub_query of the comparative questions in ``source``."""
    return f"""r AS (SELECT query_id, query, {_CLEAN} AS low, {_REST} AS rest FROM ({source})),
ab AS (SELECT *, {_strip("regexp_extract(rest, '^(.*) and (.*)$', 1)")} AS a, {_strip("regexp_extract(rest, '^(.*) and (.*)$', 2)")} AS b, regexp_matches(rest, '^.* and .*$') AS split,
  {_strip(f"regexp_extract(low, '{VERSUS}', 1)")} AS v1, {_strip(f"regexp_extract(low, '{VERSUS}', 2)")} AS v2, regexp_matches(low, '{VERSUS}') AS versus FROM r),
c AS (SELECT *, {_LONGER} AS longer FROM ab),
p AS (SELECT query_id, CASE WHEN split THEN [{_ask('longer')}, {_ask('b')}] WHEN versus THEN [{_ask('v1')}, {_ask('v2')}] ELSE [query] END AS parts FROM c),
subs AS MATERIALIZED (SELECT query_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS part, unnest(parts) AS sub_query FROM p)"""


#: CTE ``merged``: both halves in ``subs`` traversed, filtered and merged; half keys are query_id#part.
_COMPARED = f"""sub_text AS (SELECT query_id || '#' || part AS query_id, sub_query AS text FROM subs), {_vectors('sub_e', 'sub_text', 'query_id')},
half AS MATERIALIZED (SELECT query_id, 'd' || split_part(query_id, '_', 1) AS document_id, e AS q FROM sub_e),
half_scored AS MATERIALIZED (SELECT query_id, h.document_id, node_id, layer, round(list_dot_product(q, e), 6) AS score, token_count FROM half h JOIN nodes USING (document_id)),
{_traversal('half_found', 'half', ASK_LAYER, 'half_scored')}, {_in_scope('half_kept', 'half_found', ASK_RELEVANCE)}, {_distinct('half_few', 'half_kept', 0.45)},
half_once AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY part, rank) AS nth FROM (SELECT * REPLACE (split_part(query_id, '#', 1) AS query_id), CAST(split_part(query_id, '#', 2) AS INTEGER) AS part FROM half_few)),
merged AS MATERIALIZED (SELECT query_id, document_id, node_id, layer, score, token_count, part, CAST(row_number() OVER (PARTITION BY query_id ORDER BY part, rank) AS INTEGER) AS rank FROM half_once WHERE nth = 1)"""
#: CTE ``found``: nodes behind every question.
_ASKED = f"""{CLASSIFIED.replace(QUESTIONS, ASKED_QUESTIONS)}, {_decomposed("SELECT query_id, query FROM classified WHERE query_type = 'comparative'").replace("subs AS MATERIALIZED", "every_sub AS")},
subs AS MATERIALIZED (SELECT * FROM every_sub WHERE query_id IN (SELECT query_id FROM every_sub GROUP BY query_id HAVING count(*) = 2)), {_COMPARED},
one_text AS (SELECT query_id, query AS text FROM classified), {_vectors('one_e', 'one_text', 'query_id')},
one_q AS MATERIALIZED (SELECT query_id, 'd' || conv_id AS document_id, e AS q, coalesce(override, CASE WHEN query_type = 'broad' THEN 'collapsed' ELSE 'traversal' END) AS strategy FROM one_e JOIN classified USING (query_id)),
one AS MATERIALIZED (SELECT * FROM one_q WHERE query_id NOT IN (SELECT query_id FROM subs)),
one_down AS (SELECT query_id, document_id FROM one WHERE strategy = 'traversal'),
one_scored AS MATERIALIZED (SELECT query_id, o.document_id, node_id, layer, round(list_dot_product(q, e), 6) AS score, token_count FROM one o JOIN nodes USING (document_id)),
one_flat AS (SELECT s.* FROM one_scored s JOIN one USING (query_id) WHERE strategy = 'collapsed'), {_fill('flat', 'one_flat', 500)}, {_traversal('down', 'one_down', ASK_LAYER, 'one_scored')},
both_ways AS (SELECT {_FOUND} FROM flat UNION ALL SELECT {_FOUND} FROM down), {_in_scope('kept', 'both_ways', ASK_RELEVANCE)}, {_distinct('few_nodes', 'kept', 0.45)},
found AS MATERIALIZED (SELECT {_FOUND} FROM few_nodes UNION ALL SELECT {_FOUND} FROM merged)"""
_HEAD = "chr(10) || chr(10) || '=== Web Search Results ===' || chr(10)"
#: CTE ``block``: the first snippets in ``sn`` of queries that ``flags`` says need them.
_BLOCK = f"""few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS r FROM sn) WHERE r <= 3),
block AS (SELECT query_id, string_agg({_strip("coalesce(title, '') || '. ' || coalesce(body, '') || ' (Source: ' || coalesce(href, '') || ')'")}, chr(10) || chr(10) ORDER BY pos) AS b FROM few WHERE query_id IN (SELECT query_id FROM flags WHERE insufficient) GROUP BY query_id)"""
#: CTE ``prompted``: modes and prompts of the questions in ``g``.
_PROMPTED = f"""m AS (SELECT *, query_type IN ('broad', 'comparative') OR {_STARTS} AS inferential, {_strip('context')} IN ('', '{NO_RESULT}') AS none FROM g),
prompted AS (SELECT *, CASE WHEN inferential THEN 'inferential' ELSE 'factual' END AS mode, CASE WHEN inferential THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS temperature,
  CASE WHEN NOT none THEN 'Passages from the document:' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Answer from them alone: ' || query END AS prompt, CASE WHEN none THEN '{REFUSAL}' END AS answer FROM m)"""

ORACLE_SQL = {
    "document_ids": f"WITH {UPLOADS} SELECT doc_id, document_id FROM uploads",
    "dedupe_uploads": f"WITH {UPLOADS} SELECT * FROM firsts",
    "pending_documents": f"WITH {UPLOADS} SELECT * FROM firsts WHERE document_id NOT IN (SELECT document_id FROM catalog WHERE status = 'completed')",
    "fold_status": """WITH users AS (SELECT CAST(user_id AS VARCHAR) AS document_id, min(ts) AS upload_time FROM events WHERE user_id % 3 <> 0 GROUP BY user_id),
e AS (SELECT CAST(user_id AS VARCHAR) AS document_id, count(*) AS changes, arg_max(CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed: error' ELSE 'processing' END, (ts, event_id)) AS status FROM events GROUP BY user_id)
SELECT u.document_id, coalesce(e.status, 'uploaded') AS status, upload_time, coalesce(changes, 0) AS changes FROM users u LEFT JOIN e USING (document_id)""",
    "document_counts": f"WITH RECURSIVE {FOREST} SELECT document_id, count(*) AS num_chunks, count(*) AS num_nodes, count(*) FILTER (layer = 0) AS num_leaves FROM nodes GROUP BY document_id",
    "display_names": """WITH u AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS document_id, source || '_' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt' WHEN 2 THEN '.md' ELSE '.docx' END AS filename FROM documents),
s AS (SELECT *, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN document_id WHEN 2 THEN document_id || '.pdf' ELSE document_id || '_' || filename END AS stored, CASE WHEN doc_id % 5 = 0 THEN 'own ' || filename END AS own FROM u),
b AS (SELECT *, regexp_replace(CASE WHEN starts_with(stored, document_id) THEN substr(stored, length(document_id) + 1) ELSE stored END, '^_+', '') AS bare FROM s)
SELECT document_id, coalesce(own, CASE WHEN bare = '' OR starts_with(bare, '.') THEN stored ELSE bare END, 'Unknown Document') AS display_name FROM b""",
    "supported_files": f"WITH {UPLOADS} SELECT filename, regexp_matches(filename, '\\.(pdf|txt|md)$') AS accepted FROM uploads",
    "uploads_from_files": f"WITH RECURSIVE {UPLOADS} SELECT u.filename, regexp_matches(u.filename, '\\.(pdf|txt|md)$') AS accepted, sha256(text) AS content_sha256, CAST(octet_length(encode(text)) AS INTEGER) AS bytes FROM uploads u JOIN documents USING (doc_id)",
    "sidecars_from_files": f"WITH RECURSIVE {UPLOADS} SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN doc_id % 7 <> 0 THEN 'own \"' || filename || '\"' END AS original_filename FROM uploads",
    "find_documents": f"""WITH {UPLOADS}, named AS (SELECT filename, arg_min(document_id, (upload_time, document_id)) AS document_id, arg_min(status, (upload_time, document_id)) AS status FROM catalog GROUP BY filename)
SELECT doc_id AS request_id, document_id, status FROM uploads JOIN catalog USING (document_id) WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, n.document_id, n.status FROM uploads u JOIN named n USING (filename) WHERE doc_id % 2 <> 0""",
    "library_batches": f"""WITH RECURSIVE {UPLOADS}, good AS (SELECT u.*, text FROM uploads u JOIN documents d USING (doc_id) WHERE regexp_matches(filename, '\\.(pdf|txt|md)$')),
{CHUNKS.replace(SECTIONED, "sectioned AS (SELECT document_id, any_value(text) AS text FROM good GROUP BY document_id)")},
n AS (SELECT document_id, count(*) AS leaves, CAST(sum(token_count) AS BIGINT) AS tokens FROM chunks WHERE token_count >= 40 GROUP BY document_id),
b AS (SELECT document_id, arg_min(filename, (upload_time, filename)) AS every, arg_min(filename, (upload_time, filename)) FILTER (doc_id % 2 = 0) AS half, any_value(text) AS text FROM good GROUP BY document_id)
SELECT document_id, CASE WHEN half IS NOT NULL AND leaves > 0 THEN half ELSE every END AS filename, CASE WHEN {_strip('text')} = '' THEN '{EMPTY}' WHEN leaves IS NULL THEN '{NO_CHUNKS}' ELSE 'completed' END AS status,
  coalesce(leaves, 0) AS num_leaves, CASE WHEN half IS NOT NULL AND leaves > 0 THEN 1 ELSE 2 END AS batch, tokens FROM b LEFT JOIN n USING (document_id)""",
    "body_text": f"WITH {BLOCKS}, {_body('', 0.75)} SELECT * FROM bodies",
    "empty_documents": f"WITH {BLOCKS.replace('block_no % 11 = 10', 'block_no = 0 OR block_no % 11 = 10')}, {_body('', 0.125)} SELECT document_id, '{EMPTY}' AS status FROM bodies WHERE {_strip('text')} = ''",
    "split_sections": f"WITH {SECTIONS} SELECT document_id, section_no, text FROM sections",
    "sentence_split": f"WITH s AS (SELECT doc_id, {_sentences('text')} AS l FROM documents) SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS sentence_no, unnest(l) AS sentence FROM s",
    "token_counts": f"SELECT doc_id, {_tokens('text')} AS tokens FROM documents",
    "pack_chunks": f"WITH RECURSIVE {CHUNKS} SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY no) - 1 AS INTEGER) AS chunk_no, section_no, text, token_count FROM chunks WHERE token_count >= 40",
    "pack_chunks_plugged": f"WITH RECURSIVE {CHUNKS_PLUGGED} SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY no) - 1 AS INTEGER) AS chunk_no, section_no, text, token_count FROM chunks WHERE token_count >= 40",
    "chunk_report": f"""WITH RECURSIVE {CHUNKS}, c AS (SELECT document_id, count(*) FILTER (token_count >= 40) AS chunks, count(*) FILTER (token_count < 40) AS dropped FROM chunks GROUP BY document_id),
n AS (SELECT document_id, count(*) AS sections FROM sections GROUP BY document_id), o AS (SELECT document_id, count(*) FILTER (t > 100) AS oversize FROM numbered GROUP BY document_id)
SELECT document_id, CAST(coalesce(sections, 0) AS INTEGER) AS sections, CAST(coalesce(chunks, 0) AS INTEGER) AS chunks, CAST(coalesce(dropped, 0) AS INTEGER) AS dropped, CAST(coalesce(oversize, 0) AS INTEGER) AS oversize FROM sectioned LEFT JOIN n USING (document_id) LEFT JOIN c USING (document_id) LEFT JOIN o USING (document_id)""",
    "hash_embed": f"WITH {_embedded('v', 'documents', 'doc_id')} SELECT doc_id, CAST(place AS INTEGER) AS place, round(v, 6) AS value FROM v WHERE round(v, 6) <> 0",
    "flat_ip_topn": f"WITH RECURSIVE {FOREST}, best AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id DESC) AS r FROM scored) WHERE r <= 100), {_fill('found', 'best', 2000)} SELECT {_FOUND} FROM found",
    "children_of": f"""WITH RECURSIVE {FOREST}, partial_nodes AS (SELECT * FROM nodes WHERE NOT (layer = 0 AND node_id IN (3, 8))), edges AS (SELECT document_id, node_id AS parent_id, unnest(children) AS child_id, generate_subscripts(children, 1) - 1 AS pos FROM partial_nodes)
SELECT e.document_id, parent_id, CAST(pos AS INTEGER) AS pos, child_id, layer AS child_layer FROM edges e JOIN partial_nodes s ON s.document_id = e.document_id AND s.node_id = e.child_id""",
    "all_nodes": f"WITH RECURSIVE {FOREST} SELECT document_id, node_id, layer, text, token_count, children FROM nodes WHERE document_id <> 'd3'",
    "tree_summary": f"""WITH RECURSIVE {FOREST}, l AS (SELECT document_id, layer AS level, count(*) FILTER (len(children) > 0) AS num_clusters FROM nodes GROUP BY ALL), t AS (SELECT document_id, count(*) AS total_nodes, max(layer) AS max_depth FROM nodes GROUP BY ALL)
SELECT document_id, total_nodes, max_depth, level, num_clusters FROM l JOIN t USING (document_id) WHERE num_clusters > 0""",
    "forest_round_trip": f"WITH RECURSIVE {FOREST} SELECT document_id, node_id, layer, 3 AS num_layers, token_count, CAST(len(children) AS INTEGER) AS num_children, 64 AS dimensions, round(e[1]::FLOAT::DOUBLE, 5) AS first_value, round(list_sum(list_transform(e, lambda x, i: x::FLOAT::DOUBLE * i)), 3) AS every_value FROM nodes",
    "tree_json": f"WITH RECURSIVE {FOREST} SELECT document_id, node_id, layer, text, children, token_count FROM nodes",
    "query_prefix": f"WITH {QUESTIONS}, {_PREFIXED} SELECT query_id, override, query FROM prefixed WHERE query <> ''",
    "classify_rules": f"WITH {QUESTIONS} SELECT query_id, {_RULE} AS query_type FROM questions",
    "classify_nearest": f"WITH {QUESTIONS}, {_nearest('questions')} SELECT * FROM nearest",
    "route": f"WITH {CLASSIFIED} SELECT query_id, override, query_type, confidence, coalesce(override, CASE WHEN query_type = 'broad' THEN 'collapsed' ELSE 'traversal' END) AS strategy FROM classified",
    "classify_model": f"""WITH {QUESTIONS}, {_PREFIXED}, ruled AS (SELECT *, CASE WHEN override IS NULL THEN {_RULE} END AS rule, length(query) AS n FROM prefixed WHERE query <> ''),
typed AS (SELECT query_id, override, CASE WHEN override IS NOT NULL THEN 'override' WHEN rule IS NOT NULL THEN rule WHEN n % 10 / 10.0 < 0.45 THEN 'specific' ELSE ['broad', 'definitional', 'comparative'][n % 3 + 1] END AS query_type,
  CASE WHEN override IS NOT NULL OR rule IS NOT NULL THEN 1.0::DOUBLE ELSE (n % 10)::DOUBLE / 10 END AS confidence FROM ruled)
SELECT query_id, query_type, confidence, coalesce(override, CASE WHEN query_type = 'broad' THEN 'collapsed' ELSE 'traversal' END) AS strategy FROM typed""",
    "decompose_comparative": f"WITH {QUESTIONS}, {_decomposed(f'SELECT query_id, query FROM questions WHERE {_RULE} = $$comparative$$')} SELECT * FROM subs",
    "retrieve_collapsed": f"WITH RECURSIVE {FOREST}, {_TOP} SELECT {_FOUND} FROM found",
    "retrieve_traversal": f"WITH RECURSIVE {FOREST}, {_traversal('found', 'asked', 0.1)} SELECT {_FOUND} FROM found",
    "retrieve_traversal_strict": f"WITH RECURSIVE {FOREST}, {_traversal('found', 'asked', 0.3)} SELECT {_FOUND} FROM found",
    "relevant_and_distinct": f"WITH RECURSIVE {FOREST}, {_TOP}, {_in_scope('kept', 'found', 0.8)}, {_distinct('few', 'kept', 0.45)} SELECT {_FOUND} FROM few",
    "retrieve_routed": f"""WITH RECURSIVE {FOREST}, asked_c AS (SELECT * FROM asked WHERE length(query_id) % 2 = 0), asked_t AS (SELECT * FROM asked WHERE length(query_id) % 2 <> 0),
scored_c AS (SELECT s.* FROM scored s SEMI JOIN asked_c USING (query_id)), {_fill('flat', 'scored_c', 500)}, {_traversal('down', 'asked_t', 0.1)},
both_ways AS (SELECT {_FOUND} FROM flat UNION ALL SELECT {_FOUND} FROM down), {_in_scope('kept', 'both_ways', 0.45)}, {_distinct('few', 'kept', 0.45)}
SELECT {_FOUND}, CASE WHEN length(query_id) % 2 = 0 THEN 'collapsed' ELSE 'traversal' END AS strategy FROM few""",
    "comparative_merge": f"WITH RECURSIVE {NODES}, {ASKED_QUESTIONS}, {_decomposed(f'SELECT query_id, query FROM questions WHERE {_RULE} = $$comparative$$')}, {_COMPARED} SELECT query_id, document_id, node_id, layer, score, token_count, part, rank FROM merged",
    "ask_nodes": f"WITH RECURSIVE {NODES}, {_ASKED} SELECT {_FOUND} FROM found",
    "ask_batch": f"""WITH RECURSIVE {NODES}, {_ASKED}, {_ASSEMBLE}, {_best('found', ASK_INSUFFICIENT, 'one_q')},
firsts_q AS (SELECT conv_id, min(query_id) AS query_id FROM questions GROUP BY conv_id),
sn AS (SELECT query_id, page_id AS pos, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_replace(html, '<[^>]*>', '', 'g') AS body, url AS href FROM pages JOIN firsts_q ON conv_id = page_id // 4),
{_BLOCK},
g AS (SELECT c.query_id, 'd' || conv_id AS document_id, query, query_type, confidence, coalesce(override, CASE WHEN query_type = 'broad' THEN 'collapsed' ELSE 'traversal' END) AS strategy,
  CASE WHEN context IS NULL THEN '{NO_RESULT}' WHEN b IS NULL THEN context ELSE context || {_HEAD} || b END AS context, b IS NOT NULL AS external FROM classified c LEFT JOIN assembled USING (query_id) LEFT JOIN block USING (query_id)),
{_PROMPTED} SELECT query_id, document_id, query, query_type, confidence, strategy, context, external, mode, temperature, prompt, answer FROM prompted""",
    "insufficiency": f"WITH RECURSIVE {FOREST}, {_traversal('found', 'asked', 0.3)}, {_best('found', 0.35)} SELECT * FROM flags",
    "assemble_context": f"WITH RECURSIVE {FOREST}, {_TOP}, {_ASSEMBLE} SELECT * FROM assembled",
    "append_snippets": f"""WITH RECURSIVE {FOREST}, {_SMALL}, {_ASSEMBLE}, {_best('found', 0.82)},
sn AS (SELECT 'd' || (page_id // 4) || '_0' AS query_id, page_id AS pos, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_replace(html, '<[^>]*>', '', 'g') AS body, url AS href FROM pages),
{_BLOCK}
SELECT query_id, CASE WHEN b IS NULL THEN context ELSE context || {_HEAD} || b END AS context, b IS NOT NULL AS external FROM assembled LEFT JOIN block USING (query_id)""",
    "answer_prompts": f"""WITH {CLASSIFIED}, g AS (SELECT query_id, query, query_type, CASE WHEN conv_id % 5 = 0 THEN '' WHEN conv_id % 5 = 1 THEN '{NO_RESULT}' ELSE said END AS context FROM classified),
{_PROMPTED} SELECT query_id, query AS question, query_type, context, mode, temperature, prompt, answer FROM prompted""",
    "generated_answers": f"""WITH {CLASSIFIED}, g AS (SELECT query_id, query, query_type, CASE WHEN conv_id % 5 = 0 THEN '' ELSE said END AS context FROM classified),
{_PROMPTED} SELECT query_id, CASE WHEN none THEN answer WHEN length(prompt) % {BROKEN} <> 0 THEN format('{{:.1f}}', temperature::DOUBLE) || ' ' || length(prompt) END AS answer, CASE WHEN NOT none AND length(prompt) % {BROKEN} = 0 THEN 'ValueError: broken' END AS answer_error FROM prompted""",
    "soft_assign": f"""WITH RECURSIVE {FOREST}, w AS (SELECT document_id, node_id, j, (1 + (node_id * (j + 1) * 7) % 11)::DOUBLE AS x FROM leaf CROSS JOIN range(5) AS r(j)),
p AS (SELECT *, round(x / sum(x) OVER (PARTITION BY document_id, node_id), 6) AS pr FROM w)
SELECT document_id, node_id, CAST(dense_rank() OVER (PARTITION BY document_id ORDER BY j) - 1 AS INTEGER) AS cluster FROM p WHERE pr > 0.1""",
    "overflow_clusters": f"WITH RECURSIVE {FOREST}, {_LEAVES} SELECT document_id, cluster, count(*) AS members, CAST(sum(t) AS BIGINT) AS tokens FROM members GROUP BY ALL HAVING sum(t) > 250 AND count(*) > 1",
    "cluster_context": f"WITH RECURSIVE {FOREST}, {_context(100)} SELECT * FROM contexts",
    "fallback_summary": f"SELECT doc_id, {_shortened('text')} AS summary, substr({_strip("regexp_replace(text, '\\s+', ' ', 'g')")}, 1, 800) || '...' AS plain FROM documents",
    "summarize_clusters": f"WITH RECURSIVE {FOREST}, {_context(3000)} SELECT document_id, cluster, {_shortened('context')} AS summary FROM contexts",
    "model_summaries": f"""WITH RECURSIVE {FOREST}, {_context(100)} SELECT document_id, cluster, CASE WHEN length(context) % {BROKEN} = 0 THEN {_shortened('context')} ELSE array_to_string(list_slice(list_filter(regexp_split_to_array(context, '\\s+'), lambda w: w <> ''), 1, {WORDS}), ' ') END AS summary,
  length(context) % {BROKEN} <> 0 AS generated, CASE WHEN length(context) % {BROKEN} = 0 THEN 'ValueError: broken' END AS summary_error FROM contexts""",
    "verdicts": f"""WITH v AS (SELECT item_id, {_strip("CASE item_id % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'pass, fine' WHEN 2 THEN 'FAIL: ' || text ELSE text END")} AS v FROM benchmark)
SELECT item_id, starts_with(upper(v), 'PASS') AS passed, CASE WHEN starts_with(upper(v), 'PASS') THEN NULL WHEN starts_with(upper(v), 'FAIL:') THEN {_strip('substr(v, 6)')} ELSE v END AS claim FROM v""",
    "verify_summaries": f"""WITH RECURSIVE {FOREST}, {_context(100)}, a AS (SELECT *, CASE WHEN length(context) <= 250 THEN 1 ELSE 2 END AS attempt FROM contexts),
s AS (SELECT *, substr(context, 1, CAST(ceil(length(context) / attempt::DOUBLE) AS BIGINT)) AS summary FROM a)
SELECT document_id, cluster, attempt, length(summary) <= 250 AS passed, CASE WHEN length(summary) > 250 THEN {_strip('substr(summary, 1, 20)')} END AS claim FROM s""",
    "make_parents": f"""WITH RECURSIVE {FOREST}, {_context(3000)}, s AS (SELECT document_id, cluster, {_shortened('context')} AS text FROM contexts)
SELECT document_id, n + cluster AS node_id, 1 AS layer, text, (SELECT list(node_id ORDER BY node_id) FROM member m WHERE m.document_id = s.document_id AND m.cluster = s.cluster) AS children, {_tokens('text')} AS token_count FROM s JOIN sizes USING (document_id)""",
    "resume_pending": f"WITH RECURSIVE {FOREST}, {_context(100)} SELECT document_id, cluster, sha256(context) AS context_hash FROM contexts WHERE cluster % 2 <> 0 OR cluster % 6 = 0",
    "forest_invariants": f"""WITH RECURSIVE {CHUNKS} SELECT document_id, count(*) AS leaves, CAST(sum(token_count) AS BIGINT) AS leaf_tokens, CAST(sum(length(text)) AS BIGINT) AS leaf_letters, true AS dense, CAST(0 AS BIGINT) AS wrong_tokens, CAST(0 AS BIGINT) AS wrong_edges,
  CAST(0 AS BIGINT) AS orphans, CAST(0 AS BIGINT) AS wrong_texts, true AS rooted FROM chunks WHERE token_count >= 40 GROUP BY document_id""",
    "cluster_invariants": f"""WITH RECURSIVE {NODES} SELECT document_id, count(*) AS leaves, CAST(sum(token_count) AS BIGINT) AS leaf_tokens, count(DISTINCT node_id) AS covered, count(*) AS with_memberships, CAST(0 AS BIGINT) AS wrong_memberships,
  true AS dense, CAST(0 AS BIGINT) AS strange FROM nodes WHERE layer = 0 GROUP BY document_id""",
    "retrieved_by_level": f"""WITH RECURSIVE {FOREST}, {_SMALL} SELECT f.query_id, count(*) OVER (PARTITION BY f.query_id) AS total_retrieved, CAST(dense_rank() OVER (PARTITION BY f.query_id ORDER BY f.layer DESC) - 1 AS INTEGER) AS level_no, f.layer AS level,
  CAST(row_number() OVER (PARTITION BY f.query_id, f.layer ORDER BY rank) - 1 AS INTEGER) AS node_no, CAST(f.node_id AS VARCHAR) AS node_id, score AS similarity, len(children) > 0 AS has_summary FROM found f JOIN nodes n ON n.document_id = f.document_id AND n.node_id = f.node_id""",
    "retrieval_summary": f"WITH RECURSIVE {FOREST}, {_SMALL} SELECT query_id, layer AS level, count(*) AS nodes, CAST(sum(count(*)) OVER (PARTITION BY query_id) AS BIGINT) AS total FROM found GROUP BY query_id, layer",
    "level_overlay": f"""WITH RECURSIVE {FOREST}, {_SMALL}, l AS (SELECT document_id, layer AS level, count(*) AS num_clusters FROM nodes WHERE len(children) > 0 GROUP BY ALL), c AS (SELECT document_id, layer AS level, count(*) AS retrieved FROM found GROUP BY ALL)
SELECT document_id, level, num_clusters, coalesce(retrieved, 0) AS retrieved FROM l LEFT JOIN c USING (document_id, level)""",
    "top_sources": f"""WITH RECURSIVE {FOREST}, {_SMALL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY layer DESC, rank) AS place FROM found)
SELECT query_id, CAST(place AS INTEGER) AS place, r.node_id, r.layer AS level, CAST(round(score * 100) AS INTEGER) AS percent, CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.8 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN len(children) > 0 THEN text ELSE substr(text, 1, 100) || '...' END AS snippet FROM r JOIN nodes n ON n.document_id = r.document_id AND n.node_id = r.node_id WHERE place <= 3""",
    "query_log": f"WITH RECURSIVE {FOREST}, {_SMALL} SELECT query_id, document_id, CAST(count(*) AS INTEGER) AS num_nodes FROM found GROUP BY ALL",
    "find_queries": f"WITH RECURSIVE {FOREST}, {_SMALL} SELECT query_id, document_id, node_id FROM found WHERE query_id IN (SELECT query_id FROM found WHERE rank = 1 AND layer = 0)",
    "conversation_list": "SELECT conv_id, count(*) AS messages FROM conversations GROUP BY conv_id",
    "conversation_messages": "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS place, turn, role, text FROM conversations",
}
