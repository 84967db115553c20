"""DuckDB SQL of the queries that SQL can express."""

from loomspark.llm import licences

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = rf"""
WITH doc_words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[o : o + least(10, len(w)) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS o FROM item_words WHERE len(w) > 0)),
places AS (
  SELECT i, o, least(10, len(w)) AS size, array_to_string(w[o : o + least(10, len(w)) - 1], ' ') AS words
  FROM (SELECT i, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS o FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT r, size, o, array_to_string(w[o : o + size - 1], ' ') AS words
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS o FROM doc_words, sizes WHERE len(w) >= size)),
hits AS (SELECT g.r, g.o, g.size, x.item_id FROM grams g JOIN windows x USING (size, words)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(o, o + size)) AS p FROM hits) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r),
-- windows that follow each other in a document and an item are one match
met AS (SELECT g.r, p.i, p.size, g.o - p.o AS apart, g.o, g.o - row_number() OVER (PARTITION BY g.r, p.i, g.o - p.o ORDER BY g.o) AS island FROM grams g JOIN places p USING (size, words)),
matches AS (SELECT r, min(o) - 1 AS begins, count(*) + any_value(size) - 1 AS n FROM met GROUP BY r, i, apart, island),
longest AS (SELECT r, max(n) AS n_longest, arg_min(begins, (-n, begins)) AS longest_at FROM matches GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(n_longest, 0) AS BIGINT) AS n_longest, CAST(longest_at AS BIGINT) AS longest_at
FROM doc_words LEFT JOIN covered USING (r) LEFT JOIN named USING (r) LEFT JOIN longest USING (r)
"""

SQL = {"op1_decontaminate": DECONTAMINATE, "op8_licences": licences.oracle()}
