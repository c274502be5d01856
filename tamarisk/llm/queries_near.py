"""op8: the query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamarisk.llm.minhash import near_duplicates
from tamarisk.llm.tables import table


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 5], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS least FROM documents UNION SELECT e.b, r.least FROM r JOIN e ON e.a = r.node WHERE r.least < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(least) AS component_id FROM r GROUP BY 1) m USING (doc_id)
"""

QUERIES = {"op8_minhash": op8_minhash}
SQL = {"op8_minhash": OP8_SQL}
