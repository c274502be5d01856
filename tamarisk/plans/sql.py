"""SQL texts that several queries share."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[ \n\t\r\f\v]+'), lambda x: x <> '')"
PAGE_TEXT = r"regexp_replace(html, '<[^>]*>', ' ', 'g')"
DOCS, PAGES, ITEMS = "SELECT doc_id, text FROM documents", f"SELECT page_id AS doc_id, {PAGE_TEXT} AS text FROM pages", f"SELECT item_id AS query_id, {WORDS.format('text')} AS ws FROM benchmark"


def search(corpus: str = DOCS, queries: str = ITEMS, name: str = "") -> str:
    """CTEs for one corpus and query set: cos{name} and bm{name} (query_id, doc_id, score), cov{name} (…, coverage)."""
    n = name
    return f"""
q{n} AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(ws) AS term FROM ({queries})) GROUP BY ALL),
w{n} AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM ({corpus})),
t{n} AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM w{n}) GROUP BY ALL),
nd{n} AS (SELECT doc_id, sqrt(CAST(sum(tf * tf) AS DOUBLE)) AS norm FROM t{n} GROUP BY 1),
ln{n} AS (SELECT doc_id, len(ws) AS length FROM w{n}),
st{n} AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(ws)) AS mean FROM w{n}),
df{n} AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM t{n} GROUP BY 1),
qn{n} AS (SELECT query_id, sqrt(CAST(sum(qtf * qtf) AS DOUBLE)) AS qnorm FROM q{n} GROUP BY 1),
cos{n} AS (
  SELECT query_id, doc_id, round(CAST(sum(qtf * tf) AS DOUBLE) / (max(norm) * max(qnorm)), 6) AS score
  FROM q{n} JOIN t{n} USING (term) JOIN nd{n} USING (doc_id) JOIN qn{n} USING (query_id) GROUP BY 1, 2),
bm{n} AS (
  SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM q{n} JOIN t{n} USING (term) JOIN df{n} USING (term) JOIN ln{n} USING (doc_id), st{n} GROUP BY 1, 2),
cov{n} AS (SELECT query_id, doc_id, count(*) AS coverage FROM q{n} JOIN t{n} USING (term) GROUP BY 1, 2)"""


def top(source: str, k: int, by: str = "query_id") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, doc_id) AS rank FROM {source} QUALIFY rank <= {k}"


def fused(lists: str, k: int = 5) -> str:
    """Fusion of rows (query_id, list_no, rank, doc_id)."""
    return f"""
SELECT query_id, doc_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f, doc_id) AS rank FROM (
    SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (rank + 60)), 9) AS score, min(list_no * 1000 + rank) AS f FROM ({lists}) GROUP BY 1, 2)) WHERE rank <= {k}"""
