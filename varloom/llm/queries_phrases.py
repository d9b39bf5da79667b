"""op13: phrases of each language."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varloom.llm.phrases import mine_phrases


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


#: The same rows in DuckDB's SQL.
OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
k AS (SELECT unnest([1, 2, 3, 4]) AS k),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, k WHERE len(w) >= k),
f AS (SELECT lang, k, w[i:i + k - 1] AS ws, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1),
cut AS (SELECT lang, k, ws, a, unnest(range(1, k)) AS z FROM c),
s AS (
  SELECT cut.*, l.a AS l, r.a AS r, (CAST(2000000 AS HUGEINT) * cut.a) // (l.a + r.a) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.ws = cut.ws[1:z] JOIN f r ON r.lang = cut.lang AND r.ws = cut.ws[z + 1:cut.k]),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, z) = 1),
sub AS (SELECT lang, a, k, ws, unnest(range(2, k)) AS m FROM c),
held AS (SELECT lang, ws[j:j + m - 1] AS ws, max(a) AS above FROM (SELECT *, unnest(range(1, k - m + 2)) AS j FROM sub) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN held ON held.lang = best.lang AND held.ws = best.ws WHERE held.above IS NULL OR 100 * held.above < 80 * best.a),
t AS (SELECT lang, array_to_string(ws, ' ') AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(score AS BIGINT) AS score FROM kept)
SELECT t.lang, row_number() OVER (PARTITION BY t.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score
FROM t JOIN n ON n.lang = t.lang QUALIFY rank <= 2000
"""

QUERIES = {"op13_phrase_mining": op13_phrase_mining}
ORACLE_SQL = {"op13_phrase_mining": OP13_SQL}
