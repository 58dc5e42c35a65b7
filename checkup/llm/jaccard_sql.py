"""DuckDB SQL for the n-gram Jaccard join: every pair of sets with a common
shingle, counted, then components by recursion over the links."""

ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w),
n AS MATERIALIZED (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
t AS MATERIALIZED (SELECT doc_id, unnest(sh) AS g FROM s),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS at FROM n
  UNION
  SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.at)
SELECT n.doc_id, n.n AS n_shingles, min(r.at) AS component_id
FROM n JOIN reach r USING (doc_id) GROUP BY 1, 2
"""
