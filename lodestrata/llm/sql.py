"""SQL for DuckDB on the same tables, where SQL can express the query on whole tables."""

from __future__ import annotations

SAME_LINES = r"""
WITH d AS (SELECT corpus_id, any_value(string_split(text, chr(10))) AS lines FROM corpus_docs WHERE text IS NOT NULL AND corpus_id IS NOT NULL GROUP BY corpus_id),
f AS (SELECT DISTINCT finding_id, corpus_id, line, related_lines FROM lint_findings WHERE related_lines IS NOT NULL),
r AS (SELECT finding_id, lines, line, unnest(list_distinct(list_filter(related_lines, lambda x: x IS NOT NULL AND x <> line))) AS other FROM f JOIN d USING (corpus_id)),
s AS (SELECT finding_id, other,
  lower(regexp_replace(CASE WHEN line >= 1 THEN lines[line] END, '[^\p{L}\p{M}\p{N}]+', '', 'g')) AS own,
  lower(regexp_replace(CASE WHEN other >= 1 THEN lines[other] END, '[^\p{L}\p{M}\p{N}]+', '', 'g')) AS said FROM r)
SELECT finding_id AS row_id FROM s WHERE own <> '' GROUP BY finding_id HAVING 2 * count_if(said IS NOT DISTINCT FROM own) >= count(*)"""


def oracle_sql() -> dict[str, str]:
    return {"p4_same_lines": SAME_LINES}
