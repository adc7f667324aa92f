"""Query of phrase collocations over all documents, with the same counts by plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .collocations import collocations
from .common import query, table

SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
x AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM x),
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
c2 AS (SELECT f2.lang, f2.w1, f2.w2, f2.f AS a, l.f AS l, r.f AS r FROM f2 JOIN f1 l ON f2.lang = l.lang AND f2.w1 = l.w1 JOIN f1 r ON f2.lang = r.lang AND f2.w2 = r.w1),
c3 AS (SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.f AS a, h.f AS n1, lp.f AS a12, rp.f AS a23, q.f AS n3,
         1000000::HUGEINT * f3.f * f3.f // (h.f::HUGEINT * rp.f) AS s1, 1000000::HUGEINT * f3.f * f3.f // (lp.f::HUGEINT * q.f) AS s2
       FROM f3 JOIN f2 lp ON lp.lang = f3.lang AND lp.w1 = f3.w1 AND lp.w2 = f3.w2 JOIN f2 rp ON rp.lang = f3.lang AND rp.w1 = f3.w2 AND rp.w2 = f3.w3
       JOIN f1 h ON h.lang = f3.lang AND h.w1 = f3.w1 JOIN f1 q ON q.lang = f3.lang AND q.w1 = f3.w3),
m AS (SELECT lang, w1, w2, max(f) AS longer FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
u AS (SELECT c2.lang, c2.w1 || ' ' || c2.w2 AS phrase, a, l, r, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM c2 LEFT JOIN m USING (lang, w1, w2)
        WHERE longer IS NULL OR longer * 100 < a * 50
      UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN n1 ELSE a12 END, CASE WHEN s1 <= s2 THEN a23 ELSE n3 END, least(s1, s2)::BIGINT FROM c3),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM u)
SELECT lang, rank, phrase, a, l, r, n, score FROM k JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op13_collocations", SQL)
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))
