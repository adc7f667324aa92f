"""Query of the source mix over all documents, and the same apportionment in SQL with every quotient written out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import query, table
from .mixing import mix

# Block 16 words, shard 4,000,000 words, seed 17, 4096 cells; rows alike in all columns up to 4,096 times.
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT key, source, sum(size)::BIGINT AS z FROM d GROUP BY ALL),
sw AS (SELECT key, z, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 1.5::DOUBLE * sum(z) OVER ()::DOUBLE AS whole FROM s),
sr AS (SELECT *, coalesce(sum(2.0::DOUBLE * z) OVER (ORDER BY z / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
              sum(w) OVER (ORDER BY z / w, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS spread FROM sw),
sc AS (SELECT *, 2.0::DOUBLE * z < w * ((whole - held) / spread) AS full_ FROM sr),
st AS (SELECT key, z, CASE WHEN full_ THEN 2.0::DOUBLE * z ELSE w * (whole - coalesce(sum(2.0::DOUBLE * z) FILTER (WHERE full_) OVER (), 0)) / sum(w) FILTER (WHERE NOT full_) OVER () END AS target FROM sc),
p AS (SELECT d.*, target, z, floor((h >> 48) * greatest(1, least(4096, ceil(z / 4000000.0))) / 4096)::INT AS shard FROM d JOIN st USING (key)),
l AS (SELECT key, shard, sum(size)::BIGINT AS line, ceil(sum(size) / 16.0)::BIGINT AS blocks, any_value(target) AS target FROM p GROUP BY key, shard),
c AS (SELECT key, any_value(target) AS claim, sum(2 * blocks)::BIGINT AS most FROM l GROUP BY key),
n AS (SELECT floor(sum(claim) / 16 + 0.5)::BIGINT AS seats FROM c),
q1 AS (SELECT key, claim / (2 * k - 1) AS q, k FROM (SELECT key, claim, unnest(range(1, most + 1)) AS k FROM c WHERE claim > 0)),
g AS (SELECT key, count(*) AS seats FROM (SELECT key FROM q1 QUALIFY row_number() OVER (ORDER BY q DESC, key, k) <= (SELECT seats FROM n)) GROUP BY key),
q2 AS (SELECT key, shard, seats, line::DOUBLE / (2 * k - 1) AS q, k FROM (SELECT l.*, seats, unnest(range(1, 2 * blocks + 1)) AS k FROM l JOIN g USING (key) WHERE line > 0)),
v AS (SELECT key, shard, count(*) AS quota FROM (SELECT * FROM q2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY q DESC, shard, k) <= seats) GROUP BY key, shard),
f AS (SELECT l.*, coalesce(quota, 0) AS quota, ('0x' || substr(md5('17:start:' || key || ':' || shard), 1, 15))::BIGINT % greatest(blocks, 1) AS fb FROM l LEFT JOIN v USING (key, shard)),
o AS (SELECT p.doc_id, p.size, p.z, p.target, f.*,
        coalesce(sum(p.size) OVER (PARTITION BY p.key, p.shard ORDER BY p.h, p.doc_id, p.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x,
        CASE WHEN blocks > 0 THEN quota // blocks ELSE 0 END AS passes FROM p JOIN f USING (key, shard)),
r AS (SELECT *, quota - passes * blocks + fb AS stop FROM o)
SELECT doc_id, size, z AS source_size, target,
  (passes * size + greatest(0, least(size, CASE WHEN stop > blocks THEN (stop - blocks) * 16 ELSE 0 END - x))
   + greatest(0, least(size, least(line, stop * 16) - x) - greatest(0, least(line, fb * 16) - x)))::BIGINT AS taken FROM r
"""


@query("op11_mix_sources", SQL)
def op11_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
