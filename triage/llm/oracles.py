"""DuckDB SQL for the operators whose results SQL can express: all pairs, no sketches."""

from __future__ import annotations

from triage.llm import linededup, neardup, quality

_BLANK = r"[\x20\x09-\x0D]"
_WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}+'), lambda x: x <> '')"
_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_BLANK}+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 100 * c >= {neardup.PERCENT} * (m + n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.x = s.doc_id"""

LINES = f"""WITH RECURSIVE d AS (SELECT doc_id, {_LINES} AS lines FROM documents),
o AS (SELECT line, min(doc_id) AS owner FROM (SELECT doc_id, unnest(lines) AS line FROM d) GROUP BY line),
k AS (SELECT *, row_number() OVER (ORDER BY owner, line) AS id FROM o),
s AS (SELECT id, CASE WHEN length(line) < {linededup.GRAM} THEN [line] ELSE list_distinct(list_transform(range(1, length(line) - {linededup.GRAM} + 2), lambda i: substr(line, i, {linededup.GRAM}))) END AS s FROM k),
u AS (SELECT id, len(s) AS n, unnest(s) AS g FROM s),
f AS (SELECT g, count(*) AS n FROM u GROUP BY g),
v AS (SELECT id, u.n, u.g FROM u JOIN f ON f.g = u.g QUALIFY row_number() OVER (PARTITION BY id ORDER BY f.n, u.g) <= u.n - ceil({linededup.SIMILARITY} * u.n) + 1),
q AS (SELECT DISTINCT a.id AS x, b.id AS y FROM v a JOIN v b ON a.g = b.g AND a.id < b.id),
p AS (SELECT x, y, len(a.s) AS m, len(b.s) AS n, len(list_intersect(a.s, b.s)) AS c FROM q JOIN s a ON a.id = x JOIN s b ON b.id = y),
l AS (SELECT x, y FROM p WHERE c >= {linededup.SIMILARITY} * (m + n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, x AS y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x, min(y) AS root FROM r GROUP BY x),
kept AS (SELECT owner, count(*) AS n FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.x = k.id AND c.root <> k.id) GROUP BY owner)
SELECT doc_id, len(lines)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_kept, (len(lines) - coalesce(n, 0))::BIGINT AS n_removed FROM d LEFT JOIN kept ON owner = doc_id"""

WARC = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, coalesce(html, '') AS h FROM pages),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN coalesce(last, page_id) = page_id THEN 'response' ELSE 'revisit' END AS record_type, nullif(last, page_id) AS refers_to FROM r"""


def _fence(metric: str, value: str) -> str:
    return f"SELECT doc_id, lang, source, '{metric}' AS metric, {value} AS v FROM m"


_G = f"({1 + quality.ALPHA}::DOUBLE / {1 - quality.ALPHA}::DOUBLE)"
_VALUE = f"CASE WHEN b = 0 THEN 0.0::DOUBLE ELSE 1e-6::DOUBLE * pow({_G}, b - 1) * (2 / (1 + {_G})) END"


def _quartiles(by: str) -> str:
    part = f"PARTITION BY {by}, metric" if by else "PARTITION BY metric"
    keys = f"{by}, metric" if by else "metric"
    return f"""SELECT {keys}, max(docs) AS docs, min(val) FILTER (upto >= docs * 0.25) AS q1, min(val) FILTER (upto >= docs * 0.75) AS q3
 FROM (SELECT {keys}, {_VALUE} AS val, sum(n) OVER ({part} ORDER BY b) AS upto, sum(n) OVER ({part}) AS docs FROM (SELECT {keys}, b, sum(n) AS n FROM sk GROUP BY ALL)) GROUP BY {keys}"""


def _drawn(q: str) -> str:
    k = f"{quality.SHRINK}::DOUBLE"
    return f"(q.docs * q.{q} + {k} * ((ql.docs * ql.{q} + {k} * qe.{q}) / (ql.docs + {k}))) / (q.docs + {k})"


_WIDTH = "CASE metric " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in quality.FENCES.items()) + " END::DOUBLE"
_SLACK = "CASE metric " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in quality.FENCES.items()) + " END::DOUBLE"

QUALITY = f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w, {_LINES} AS l FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM win),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
 len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS n_stutter FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
x AS ({_fence('symbol_ratio', 'n_symbols::DOUBLE / nullif(word_chars, 0)')} UNION ALL {_fence('dup_line_ratio', 'n_dup_lines::DOUBLE / nullif(n_lines, 0)')}
 UNION ALL {_fence('stutter_ratio', 'n_stutter::DOUBLE / nullif(n_words, 0)')} UNION ALL {_fence('mean_word', 'word_chars::DOUBLE / nullif(n_words, 0)')}),
sk AS (SELECT lang, source, metric, CASE WHEN v <= 0 THEN 0 ELSE greatest(1, ceil(ln(v / 1e-6::DOUBLE) / ln({_G}))::INTEGER + 1) END AS b, count(*) AS n
 FROM x WHERE v IS NOT NULL AND doc_id IN (SELECT doc_id FROM base WHERE NOT base_failed) GROUP BY ALL),
q AS ({_quartiles('lang, source')}), ql AS ({_quartiles('lang')}), qe AS ({_quartiles('')}),
f AS (SELECT q.lang, q.source, q.metric, {_drawn('q1')} AS q1, {_drawn('q3')} AS q3
 FROM q JOIN ql ON ql.lang IS NOT DISTINCT FROM q.lang AND ql.metric = q.metric JOIN qe ON qe.metric = q.metric),
fence AS (SELECT lang, source, metric, q1 - greatest({_WIDTH} * (q3 - q1), {_SLACK}) AS low, q3 + greatest({_WIDTH} * (q3 - q1), {_SLACK}) AS high FROM f),
odd AS (SELECT DISTINCT x.doc_id FROM x JOIN fence f ON f.lang IS NOT DISTINCT FROM x.lang AND f.source IS NOT DISTINCT FROM x.source AND f.metric = x.metric WHERE x.v > f.high OR (x.metric = 'mean_word' AND x.v < f.low))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM odd) AS kept FROM base"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": LINES, "op5_quality": QUALITY, "op7_warc": WARC, "op8_near_duplicates": NEAR}
