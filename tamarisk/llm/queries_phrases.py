"""op12: the query and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamarisk.llm.collocations import collocations
from tamarisk.llm.tables import table


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, k, array_to_string(ws[i + 1 : i + k], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(0, len(ws) - k + 1)) AS i FROM w, (VALUES (1), (2), (3)) AS ks(k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k >= 2 AND f >= 10),
m AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN m USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(ws[1 : cut], ' ') AS head, array_to_string(ws[cut + 1 :], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
s AS (
  SELECT u.lang, u.phrase, a, cut, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts u JOIN f x ON x.lang = u.lang AND x.phrase = head JOIN f y ON y.lang = u.lang AND y.phrase = tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b JOIN n USING (lang) QUALIFY rank <= 2000
"""

QUERIES = {"op12_collocations": op12_collocations}
SQL = {"op12_collocations": OP12_SQL}
