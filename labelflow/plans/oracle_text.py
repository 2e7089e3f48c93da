"""Oracle CTEs for text zones and phrase matching (DuckDB / RE2 dialect).

RE2 has no look-behind, so a word-bounded occurrence is written with
explicit neighbour groups: ``(^|[^\\p{L}])term([^\\p{L}]|$)``.
"""

ESC = r"""regexp_replace({x}, '([()\[\]{{}}?*+\-|^$\\.&~# \t\n\r\f\x0B])', '\\\1', 'g')"""


def esc(x: str) -> str:
    return ESC.format(x=x)


def bounded(text: str, term: str) -> str:
    return f"regexp_matches({text}, '(^|[^\\p{{L}}])' || {esc(term)} || '([^\\p{{L}}]|$)')"


PREFIX = r"'^[^.]{0,200}\.\s*'"

TEXT_CTES = f"""
stripped AS (
  SELECT doc_id, CASE WHEN m <> '' THEN substr(text, length(m) + 1) ELSE text END AS text FROM (
    SELECT doc_id, text, regexp_extract(substr(text, 1, 500), {PREFIX}) AS m FROM documents) x),
title AS (
  SELECT doc_id, substr(CASE WHEN m <> '' THEN substr(text, length(m) + 1) ELSE text END, 1, 600) AS title FROM (
    SELECT doc_id, text, regexp_extract(substr(text, 1, 500), {PREFIX}) AS m FROM stripped) x),
ztexts AS (
  SELECT doc_id, 'full' AS zone, lower(text) AS ztext FROM stripped
  UNION ALL SELECT doc_id, 'title' AS zone, lower(title) AS ztext FROM title),
lit AS (SELECT pattern_id, code, match_zone, lower(source_text) AS term FROM pat WHERE len(parts) = 1),
fz AS (SELECT pattern_id, code, match_zone, parts FROM pat WHERE len(parts) >= 2),
lit_hits AS (
  SELECT z.doc_id, z.zone, l.pattern_id, l.code FROM ztexts z JOIN lit l ON z.zone = l.match_zone
  WHERE {bounded('z.ztext', 'l.term')}),
fz_parts AS (SELECT pattern_id, code, match_zone, parts, unnest(parts) AS part FROM fz),
fz_cand AS (
  SELECT z.doc_id, z.zone, f.pattern_id, f.code, f.parts FROM ztexts z JOIN fz_parts f ON z.zone = f.match_zone
  WHERE {bounded('z.ztext', 'f.part')}
  GROUP BY z.doc_id, z.zone, f.pattern_id, f.code, f.parts
  HAVING count(DISTINCT f.part) = len(list_distinct(f.parts))),
fz_hits AS (
  SELECT c.doc_id, c.zone, c.pattern_id, c.code FROM fz_cand c JOIN ztexts z ON z.doc_id = c.doc_id AND z.zone = c.zone
  WHERE regexp_matches(z.ztext, '(?s)' || array_to_string(list_transform(c.parts, lambda x: {esc('x')}), '.{{0,80}}'))),
hits AS (SELECT * FROM lit_hits UNION ALL SELECT * FROM fz_hits)
"""
