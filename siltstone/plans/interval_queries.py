"""Queries on byte ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import intervals as iv
from siltstone.plans.derive import cte, extents, frame

_E = "logical_offset + length"
_CUT = f"greatest(logical_offset, range_start) AS s, least({_E}, range_end) AS e"
_HIT = f"logical_offset < range_end AND {_E} > range_start"

QUERIES = {
    "extent_partition_check": lambda s, d: iv.partition_check(extents(s, d)),
    "range_read_extents": lambda s, d: iv.range_read(extents(s, d), frame(s, d, "ranges")).select("file_id", "ordinal", "logical_offset", "length", "kind"),
    "slice_extents": lambda s, d: iv.slice_extents(extents(s, d), frame(s, d, "ranges")),
    "allocated_in_range": lambda s, d: iv.allocated_in_range(extents(s, d), frame(s, d, "ranges")),
    "scan_summary": lambda s, d: iv.scan_summary(extents(s, d)),
    "coalesce_ranges": lambda s, d: iv.coalesce_ranges(frame(s, d, "dirty")),
    "lww_overlay": lambda s, d: iv.overlay(frame(s, d, "writes")),
    "truncate": lambda s, d: iv.truncate(extents(s, d), frame(s, d, "ranges").select("file_id", F.col("range_end").alias("new_size"))),
    "clone_contract": lambda s, d: iv.clone_contract(frame(s, d, "clone_requests")).groupBy("status").agg(F.count("*").alias("requests"), F.min("request_id").alias("first_request")),
    "manifest_choice": lambda s, d: iv.manifest_choice(frame(s, d, "manifests")).select("file_id", "choice"),
    "splice": lambda s, d: iv.splice(extents(s, d), frame(s, d, "ranges").withColumn("new_length", F.lit(700).cast("long"))).groupBy("file_id").agg(F.max(F.col("logical_offset") + F.col("length")).alias("new_size"), F.count("*").alias("extents"), F.sum("length").alias("covered")),
    "recipe_leaves": lambda s, d: iv.leaves(extents(s, d)).groupBy("file_id", "window", "leaf").agg(F.count("*").alias("extents"), F.sum("length").alias("bytes")),
    "rechunk_ranges": lambda s, d: iv.rechunk_ranges(frame(s, d, "ranges"), extents(s, d), 4096),
    "range_difference": lambda s, d: iv.subtract_ranges(frame(s, d, "dirty"), frame(s, d, "writes").select("file_id", "range_start", "range_end")),
}


def _islands(table: str) -> str:
    return f"""SELECT file_id, min(range_start) AS range_start, max(range_end) AS range_end FROM (
  SELECT *, sum(n) OVER (PARTITION BY file_id ORDER BY range_start, range_end ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN range_start <= max(range_end) OVER (PARTITION BY file_id ORDER BY range_start, range_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n
    FROM {table} WHERE range_end > range_start)) GROUP BY file_id, island"""


ORACLES = {
    "extent_partition_check": cte("extents") + f"""
SELECT file_id, max({_E}) AS logical_size, count(*) AS extents,
  bool_and(coalesce(p, 0) = logical_offset AND length > 0 AND (kind <> 'SLICE' OR (chunk_offset >= 0 AND chunk_offset + length <= chunk_length AND length < chunk_length))) AS valid
FROM (SELECT *, lag({_E}) OVER (PARTITION BY file_id ORDER BY ordinal) AS p FROM extents) GROUP BY file_id""",
    "range_read_extents": cte("extents", "ranges") + f" SELECT file_id, ordinal, logical_offset, length, kind FROM extents JOIN ranges USING (file_id) WHERE {_HIT}",
    "slice_extents": cte("extents", "ranges") + f""", c AS (SELECT *, {_CUT} FROM extents JOIN ranges USING (file_id) WHERE {_HIT})
SELECT file_id, ordinal, s AS logical_offset, e - s AS length, CASE WHEN kind = 'DATA' AND (s > logical_offset OR e < {_E}) THEN 'SLICE' ELSE kind END AS kind,
  chunk_id, chunk_offset + s - logical_offset AS chunk_offset, chunk_length FROM c""",
    "allocated_in_range": cte("extents", "ranges") + f"""
SELECT r.file_id, CAST(coalesce(sum(CASE WHEN kind <> 'HOLE' AND {_HIT} THEN least({_E}, range_end) - greatest(logical_offset, range_start) END), 0) AS BIGINT) AS allocated
FROM ranges r LEFT JOIN extents x ON x.file_id = r.file_id GROUP BY r.file_id""",
    "scan_summary": cte("extents") + f"""
SELECT file_id, max({_E}) AS logical_size, CAST(sum(CASE WHEN kind <> 'HOLE' THEN length ELSE 0 END) AS BIGINT) AS allocated, count(DISTINCT logical_offset // 67108864) AS windows FROM extents GROUP BY file_id""",
    "coalesce_ranges": cte("dirty") + " " + _islands("dirty"),
    "lww_overlay": cte("writes") + """, p AS (SELECT file_id, range_start AS a FROM writes UNION SELECT file_id, range_end FROM writes),
c AS (SELECT file_id, a, lead(a) OVER (PARTITION BY file_id ORDER BY a) AS b FROM p),
w AS (SELECT c.file_id, a, b, max(seq) AS seq FROM c JOIN writes w ON w.file_id = c.file_id AND range_start <= a AND range_end >= b GROUP BY ALL),
f AS (SELECT *, CASE WHEN lag(seq) OVER k = seq AND lag(b) OVER k = a THEN 0 ELSE 1 END AS n FROM w WINDOW k AS (PARTITION BY file_id ORDER BY a)),
r AS (SELECT *, sum(n) OVER (PARTITION BY file_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT file_id, seq, min(a) AS range_start, max(b) AS range_end FROM r GROUP BY file_id, run, seq""",
    "truncate": cte("extents", "ranges") + f""", z AS (SELECT file_id, range_end AS new_size FROM ranges), ends AS (SELECT file_id, max({_E}) AS fe FROM extents GROUP BY 1)
SELECT file_id, logical_offset, least({_E}, new_size) - logical_offset AS length, CASE WHEN kind = 'DATA' AND {_E} > new_size THEN 'SLICE' ELSE kind END AS kind, chunk_id, chunk_offset, chunk_length FROM extents JOIN z USING (file_id) WHERE logical_offset < new_size
UNION ALL SELECT file_id, coalesce(fe, 0), new_size - coalesce(fe, 0), 'HOLE', NULL, 0, 0 FROM z LEFT JOIN ends USING (file_id) WHERE new_size > coalesce(fe, 0)""",
    "clone_contract": cte("clone_requests") + """
SELECT CASE WHEN length = 0 OR alignment < 4096 OR bit_count(alignment) <> 1 OR maximum_length = 0 THEN 'INVALID_PARAMETER' WHEN length > maximum_length THEN 'CLONE_TOO_LARGE'
  WHEN source_offset % alignment <> 0 OR target_offset % alignment <> 0 OR length % alignment <> 0 THEN 'MISALIGNED'
  WHEN CAST(source_offset AS HUGEINT) + length > 9223372036854775807 OR CAST(target_offset AS HUGEINT) + length > 9223372036854775807 THEN 'INVALID_PARAMETER'
  WHEN CAST(source_offset AS HUGEINT) + length > source_size THEN 'SOURCE_OUT_OF_BOUNDS' WHEN target_offset + length > target_size THEN 'TARGET_NOT_PRESIZED'
  WHEN same_file AND source_offset < target_offset + length AND target_offset < source_offset + length THEN 'OVERLAP' ELSE 'OK' END AS status,
  count(*) AS requests, min(request_id) AS first_request FROM clone_requests GROUP BY 1""",
    "manifest_choice": cte("manifests") + """
SELECT file_id, CASE WHEN old_size IS NULL THEN 'COMPLETE' WHEN changed_ranges = 0 AND new_size = old_size THEN 'REUSE' WHEN changed_ranges = 0 AND new_size < old_size THEN 'TRUNCATE'
  WHEN new_size > old_size AND (changed_ranges = 0 OR first_changed >= old_size) THEN 'APPEND' WHEN new_size = old_size THEN 'REPLACE' ELSE 'COMPLETE' END AS choice FROM manifests""",
    "splice": cte("extents", "ranges") + f""", z AS (SELECT x.file_id, x.fe, range_start AS a, range_end AS b FROM (SELECT file_id, max({_E}) AS fe FROM extents GROUP BY 1) x LEFT JOIN ranges r USING (file_id)),
p AS (SELECT file_id, logical_offset AS o, least({_E}, coalesce(a, fe)) AS e FROM extents JOIN z USING (file_id) WHERE logical_offset < coalesce(a, fe)
  UNION ALL SELECT file_id, a, a + 700 FROM z WHERE a <= fe
  UNION ALL SELECT file_id, greatest(logical_offset, b) + 700 - (b - a), {_E} + 700 - (b - a) FROM extents JOIN z USING (file_id) WHERE {_E} > b)
SELECT file_id, max(e) AS new_size, count(*) AS extents, CAST(sum(e - o) AS BIGINT) AS covered FROM p GROUP BY file_id""",
    "recipe_leaves": cte("extents") + """
SELECT file_id, "window", leaf, count(*) AS extents, CAST(sum(length) AS BIGINT) AS bytes FROM (
  SELECT file_id, length, logical_offset // 67108864 AS "window", (row_number() OVER (PARTITION BY file_id, logical_offset // 67108864 ORDER BY logical_offset) - 1) // 1024 AS leaf FROM extents) GROUP BY ALL""",
    "rechunk_ranges": cte("ranges", "extents") + f""", g AS (SELECT file_id, range_start // 4096 * 4096 AS range_start, least((range_end + 4095) // 4096 * 4096, fe) AS range_end
  FROM ranges JOIN (SELECT file_id, max({_E}) AS fe FROM extents GROUP BY 1) USING (file_id)),
m AS ({_islands("g")}),
t AS (SELECT * FROM m UNION ALL SELECT file_id, logical_offset, {_E} FROM extents JOIN m USING (file_id) WHERE kind = 'DATA' AND {_HIT})
{_islands("t")}""",
    "range_difference": cte("dirty", "writes") + f""", a AS ({_islands("dirty")}), b AS ({_islands("writes")}),
s AS (SELECT file_id, range_start AS k, 1 AS x, 0 AS y FROM a UNION ALL SELECT file_id, range_end, -1, 0 FROM a UNION ALL SELECT file_id, range_start, 0, 1 FROM b UNION ALL SELECT file_id, range_end, 0, -1 FROM b),
e AS (SELECT file_id, k, sum(x) AS x, sum(y) AS y FROM s GROUP BY ALL),
c AS (SELECT file_id, k AS range_start, lead(k) OVER w AS range_end, sum(x) OVER w AS x, sum(y) OVER w AS y FROM e WINDOW w AS (PARTITION BY file_id ORDER BY k)),
d AS (SELECT file_id, range_start, range_end FROM c WHERE x > 0 AND y = 0)
{_islands("d")}""",
}
