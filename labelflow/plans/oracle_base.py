"""Fixture views as SQL common table expressions for the independent oracle.

The same definitions as ``labelflow.sources.fixtures`` written in portable
SQL (runs unchanged in DuckDB and Spark SQL).  Each oracle query is
``WITH <BASE>, ... SELECT ...``.
"""

BASE = r"""
truth AS (
  SELECT doc_id, CASE lang WHEN 'en' THEN 10 WHEN 'fr' THEN 20 WHEN 'de' THEN 30 ELSE 40 END AS code FROM documents
  UNION ALL SELECT doc_id, 100 + CAST(substr(source, 4) AS INT) AS code FROM documents
  UNION ALL SELECT doc_id, CASE WHEN quality = 1 THEN 1 ELSE 3 END AS code FROM labels
  UNION ALL SELECT doc_id, 2 AS code FROM labels WHERE toxic = 1),
label_space AS (
  SELECT code, CAST(row_number() OVER (ORDER BY code) - 1 AS INT) AS idx FROM (SELECT DISTINCT code FROM truth) t),
splits AS (
  SELECT doc_id, stratum, rn, CAST((rn - 1) % 5 AS INT) AS fold,
         CASE WHEN rn <= floor(n * 0.10 + 0.5) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT doc_id, stratum,
               row_number() OVER (PARTITION BY stratum ORDER BY md5(concat('42|', CAST(doc_id AS VARCHAR(20)))), doc_id) AS rn,
               count(*) OVER (PARTITION BY stratum) AS n
        FROM (SELECT doc_id, code AS stratum FROM
                (SELECT t.doc_id, t.code, row_number() OVER (PARTITION BY t.doc_id ORDER BY s.n, t.code) AS r
                 FROM truth t JOIN (SELECT code, count(*) AS n FROM truth GROUP BY code) s ON t.code = s.code) a
              WHERE r = 1) b) c),
g AS (
  SELECT k.doc_id, k.code, CASE WHEN t.code IS NULL THEN 0 ELSE 1 END AS y,
         CAST((k.doc_id * 7919 + k.code * 104729 + 1299709) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) AS u1,
         CAST((k.doc_id * 7919 + k.code * 104729 + 2599418) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE) AS u2
  FROM (SELECT d.doc_id, l.code FROM documents d CROSS JOIN label_space l) k
  LEFT JOIN truth t ON k.doc_id = t.doc_id AND k.code = t.code),
preds AS (
  SELECT method, doc_id, code, score, score >= 5e-1 AS predicted FROM (
    SELECT 'm1' AS method, doc_id, code, CASE WHEN y = 1 THEN 3e-1 + 7e-1 * u1 ELSE 75e-2 * u1 * u1 * u1 END AS score FROM g
    UNION ALL
    SELECT 'm2' AS method, doc_id, code, CASE WHEN y = 1 THEN u2 ELSE 6e-1 * u2 * u2 END AS score FROM g) p),
curated AS (
  SELECT * FROM (VALUES
   (1,10,'seed','the','full'),(2,10,'seed','and','full'),(3,10,'seed','that … the','full'),(4,10,'seed','this','title'),
   (5,20,'seed','les','full'),(6,20,'seed','dans','full'),(7,20,'seed','que … des','full'),(8,20,'seed','une','title'),
   (9,30,'seed','und','full'),(10,30,'seed','für','full'),(11,30,'seed','der … die','full'),(12,30,'seed','nicht','title'),
   (13,40,'seed','los','full'),(14,40,'seed','para','full'),(15,40,'seed','que … las','full'),(16,40,'seed','del','title'),
   (17,2,'seed','licensed under','full'),(18,2,'seed','apache license','full'),
   (19,1,'seed','released under the mit license','full'),(20,3,'seed','cc by-nc 4.0','full')
  ) AS t(ord, code, source, phrase, match_zone)),
pat AS (
  SELECT code, source, phrase AS source_text, match_zone, ord,
         CAST(code AS VARCHAR) || '-' || source || '-' ||
           lpad(CAST(row_number() OVER (PARTITION BY code, source ORDER BY ord) AS VARCHAR), 3, '0') AS pattern_id,
         list_filter(list_transform(regexp_split_to_array(phrase, '\s*(?:…|\.{2,})\s*'), lambda x: lower(trim(x))),
                     lambda x: x <> '') AS parts
  FROM curated),
chunk_vecs AS (
  SELECT CAST(floor(vec_id / 4) AS BIGINT) AS doc_id, CAST(vec_id % 4 AS INT) AS chunk_no, embedding,
         CAST(1 + vec_id % 7 AS INT) AS n_tokens FROM embeddings),
counts AS (
  SELECT p.method, p.code,
         CAST(sum(CASE WHEN p.predicted AND t.code IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN p.predicted AND t.code IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN (NOT p.predicted) AND t.code IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS fn,
         CAST(sum(CASE WHEN t.code IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS support
  FROM preds p LEFT JOIN truth t ON p.doc_id = t.doc_id AND p.code = t.code
  GROUP BY p.method, p.code),
per_class AS (
  SELECT method, code,
         round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END, 4) AS precision,
         round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END, 4) AS recall,
         round(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END, 4) AS f1,
         support
  FROM counts)
"""


def with_base(extra_ctes: str, select: str) -> str:
    """``WITH BASE, extra SELECT``; ``extra_ctes`` may be empty."""
    ctes = BASE.strip()
    if extra_ctes.strip():
        ctes += ",\n" + extra_ctes.strip()
    return "WITH " + ctes + "\n" + select.strip()
