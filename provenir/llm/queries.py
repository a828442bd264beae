"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from provenir.llm import answers, file_origin, group_splits, leakage, mixing, near_duplicates, personal_data, split_overlap, syntax, truncation

QUERIES = {
    f.__name__: f
    for f in (
        split_overlap.p1_found, split_overlap.p1_report, truncation.p2_found, truncation.p2_report, syntax.p3_found, syntax.p3_files, syntax.p3_report, answers.p4_found, answers.p4_report,
        file_origin.p5_found, file_origin.p5_report, group_splits.p6_found, group_splits.p6_assignment, group_splits.p6_report, group_splits.p6_invariants, near_duplicates.p7_found, near_duplicates.p7_links, near_duplicates.p7_groups,
        leakage.p8_found, leakage.p8_spans, leakage.p8_verbatim, leakage.p8_report, mixing.p9_selection, mixing.p9_report, mixing.p9_checks, personal_data.p10_found, personal_data.p10_redacted, personal_data.p10_report,
    )
}

_LIKE = """
t AS (SELECT key, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
      FROM (SELECT key, regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]') AS w FROM (SELECT DISTINCT key, text FROM source WHERE text IS NOT NULL AND trim(text, E' \\t\\n\\r') <> '')) WHERE len(w) > 2),
e AS (SELECT key, len(g) AS n, unnest(g) AS s FROM t),
f AS (SELECT s, count(*) AS df FROM e GROUP BY s),
r AS (SELECT e.key, e.n, e.s, row_number() OVER (PARTITION BY e.key ORDER BY f.df, e.s) AS k FROM e JOIN f USING (s)),
p AS (SELECT DISTINCT a.key AS ka, b.key AS kb FROM r a JOIN r b ON a.s = b.s AND a.key < b.key WHERE a.k <= a.n - ceil(0.7 * a.n) + 1 AND b.k <= b.n - ceil(0.7 * b.n) + 1),
l AS (SELECT ka, kb FROM p JOIN t x ON x.key = ka JOIN t y ON y.key = kb WHERE len(list_intersect(x.g, y.g)) >= 0.7 * (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))))
"""

_WORDS = "' ' || array_to_string(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'), ' ') || ' '"


def _tied(field: str, source: str) -> str:
    """Groups of one field's records over like and equal texts, with links and copies."""
    return f"""SELECT '{field}' AS field, * FROM (WITH RECURSIVE source AS ({source}), {_LIKE.strip()},
m AS (SELECT DISTINCT key, text FROM source WHERE key IS NOT NULL AND text IS NOT NULL AND trim(text, E' \\t\\n\\r') <> ''), same AS (SELECT a.key AS ka, b.key AS kb FROM m a JOIN m b ON a.text = b.text WHERE a.key <> b.key),
both_ways AS (SELECT ka, kb FROM l UNION SELECT kb, ka FROM l), edge AS (SELECT ka, kb FROM both_ways UNION SELECT ka, kb FROM same),
walk(x, y) AS (SELECT key, key FROM m UNION SELECT walk.x, edge.kb FROM walk JOIN edge ON walk.y = edge.ka)
SELECT m.key, g.group_key, coalesce(k.links, 0) AS links, c.copies FROM m JOIN (SELECT x, min(y) AS group_key FROM walk GROUP BY 1) g ON g.x = m.key JOIN (SELECT text, count(*) AS copies FROM m GROUP BY 1) c ON c.text = m.text
LEFT JOIN (SELECT b.ka, count(DISTINCT o.text) AS links FROM both_ways b JOIN m a ON a.key = b.ka JOIN m o ON o.key = b.kb WHERE a.text <> o.text GROUP BY 1) k ON k.ka = m.key)"""


ORACLE_SQL = {
    "p1_found": f"""
WITH source AS (SELECT idx AS key, code AS text FROM code_pairs WHERE idx IS NOT NULL AND split IS NOT NULL), {_LIKE.strip()},
side AS (SELECT idx, bool_or(lower(trim(split)) = 'train') AS in_train FROM code_pairs WHERE split IS NOT NULL GROUP BY idx)
SELECT DISTINCT ka AS idx_a, kb AS idx_b FROM l JOIN side a ON a.idx = ka JOIN side b ON b.idx = kb WHERE a.in_train <> b.in_train""",
    "p6_found": """
WITH RECURSIVE h AS (SELECT DISTINCT line_no, regexp_extract(lower(human_sha256), '[0-9a-f]{64}') AS hash FROM checkpoints WHERE line_no IS NOT NULL AND human_sha256 IS NOT NULL),
s AS (SELECT * FROM h WHERE hash <> ''),
edge AS (SELECT DISTINCT a.line_no AS x, b.line_no AS y FROM s a JOIN s b USING (hash) WHERE a.line_no <> b.line_no),
walk(x, y) AS (SELECT x, y FROM edge UNION SELECT walk.x, edge.y FROM walk JOIN edge ON walk.y = edge.x)
SELECT x AS line_no, least(x, min(y)) AS group_line_no FROM walk GROUP BY x""",
    "p6_invariants": """
SELECT count(DISTINCT line_no) AS lines, count(DISTINCT line_no) AS distinct_lines, 0::BIGINT AS without_split, 0::BIGINT AS torn, 1 AS shares_met FROM checkpoints WHERE line_no IS NOT NULL AND tag IS NOT NULL""",
    "p9_checks": "SELECT source, 1 AS share_met, 1 AS repeats_kept, 1 AS ids_kept FROM mix_targets WHERE source IS NOT NULL",
    "p7_groups": _tied("code", "SELECT idx AS key, code AS text FROM code_pairs WHERE idx IS NOT NULL") + " UNION ALL " + _tied("agc_code", "SELECT line_no || '_' || tag AS key, agc_code AS text FROM checkpoints WHERE line_no IS NOT NULL AND tag IS NOT NULL"),
    "p8_verbatim": f"""
SELECT d.doc_id, i.item_id FROM (SELECT DISTINCT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) d
JOIN (SELECT DISTINCT item_id, {_WORDS.format("item_text")} AS w FROM heldout_items WHERE item_id IS NOT NULL AND item_text IS NOT NULL) i ON contains(d.w, i.w) WHERE trim(i.w) <> '' GROUP BY 1, 2""",
    "p7_found": f"""
SELECT 'code' AS field, ka AS key_a, kb AS key_b FROM (WITH source AS (SELECT idx AS key, code AS text FROM code_pairs WHERE idx IS NOT NULL), {_LIKE.strip()} SELECT DISTINCT ka, kb FROM l)
UNION ALL
SELECT 'agc_code', ka, kb FROM (WITH source AS (SELECT line_no || '_' || tag AS key, agc_code AS text FROM checkpoints WHERE line_no IS NOT NULL AND tag IS NOT NULL), {_LIKE.strip()} SELECT DISTINCT ka, kb FROM l)""",
}
