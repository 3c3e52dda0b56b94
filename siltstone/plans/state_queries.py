"""Queries on the index, generations, maintenance and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import dedup, generations, index, maintenance, report
from siltstone.plans.derive import cte, frame


def _families(s, d):
    e = frame(s, d, "entries").withColumn("family", F.col("generation") % 13)
    return index.families(e)


def _files(chunks):
    """Container files: payload, an entry for each chunk, header and index."""
    return chunks.groupBy("container_id").agg((F.sum("logical_length") + 383 * F.count("*") + 12351).alias("file_bytes"))


def _states(s, d):
    chunks = frame(s, d, "container_chunks")
    online = generations.online_set(frame(s, d, "required"))
    return chunks, online, maintenance.classify(chunks, online, _files(chunks))


def _gc(s, d):
    chunks, online, states = _states(s, d)
    return maintenance.gc_plan(states, maintenance.replacement_set(chunks, online, states))


def _names(s, d):
    return frame(s, d, "namespace_names")


def _namespace(s, d):
    names = _names(s, d)
    inodes = names.groupBy(F.col("target").alias("inode")).agg(F.count("*").alias("n"))
    inodes = inodes.where("inode % 17 != 0").select("inode", (F.col("n") + (F.col("inode") % 19 == 0).cast("int")).alias("link_count"))
    return generations.namespace_faults(inodes, names)


def _raw_records():
    """Raw records of a region cut into equal chunks, the last with the rest."""
    part = F.expr("raw_bytes DIV chunks")
    return report.raw_records(F.concat(F.array_repeat(part, (F.col("chunks") - 1).cast("int")), F.array(F.col("raw_bytes") - part * (F.col("chunks") - 1))))


def _records(s, d):
    r = frame(s, d, "records")
    c = F.col
    return r.select(
        "record_id", "line", report.record_bytes(c("payload_bytes"), c("chunks")).alias("record_bytes"), report.payload_cap(_raw_records(), c("chunks")).alias("payload_cap"),
        report.zstd_accepts(c("raw_bytes"), c("payload_bytes")).alias("zstd"), report.delta_accepts(c("raw_bytes"), c("payload_bytes")).alias("delta"),
    ).groupBy("zstd", "delta").agg(F.count("*").alias("records"), F.sum("record_bytes").alias("record_bytes"), F.sum("payload_cap").alias("payload_cap"))


def _reorder(s, d):
    regions = frame(s, d, "extents").select(F.col("file_id").alias("object_id"), "ordinal", F.floor(F.col("logical_offset") / 16384).cast("long").alias("window"), F.col("chunk_id").alias("features"))
    return report.reorder_rank(regions).select("object_id", "ordinal", "place", "reordered")


QUERIES = {
    "run_merge_newest_wins": lambda s, d: index.newest_wins(frame(s, d, "entries")),
    "lookup_top64": lambda s, d: index.lookup(frame(s, d, "entries").withColumn("logical_length", F.lit(4096).cast("long"))).groupBy("chunk_id").agg(F.count("*").alias("found"), F.bool_and("complete").alias("complete"), F.min("generation").alias("oldest"), F.sum(F.col("rank") * F.col("generation")).alias("order_sum")),
    "candidate_two_active": lambda s, d: index.resolve(frame(s, d, "entries")),
    "index_families": _families,
    "compaction_selection": lambda s, d: index.compaction_selection(_families(s, d)),
    "index_orphans": lambda s, d: index.orphans(frame(s, d, "entries"), frame(s, d, "container_chunks")),
    "duplicate_locations": lambda s, d: index.duplicate_locations(frame(s, d, "entries").withColumn("generation", F.col("level"))),
    "length_conflicts": lambda s, d: dedup.length_conflicts(frame(s, d, "extents"), "chunk_length"),
    "commit_chain_check": lambda s, d: generations.decode_log(frame(s, d, "commit_log")).select("log_id", "position", "fault", "valid"),
    "commit_log_tail": lambda s, d: generations.log_tail(frame(s, d, "commit_log")),
    "generation_transitions": lambda s, d: generations.transition_faults(frame(s, d, "roots"), frame(s, d, "root_inodes")),
    "namespace_validation": _namespace,
    "required_set": lambda s, d: generations.required_set(frame(s, d, "extents")),
    "online_set": lambda s, d: generations.online_set(frame(s, d, "required")),
    "new_requirements": lambda s, d: generations.new_requirements(frame(s, d, "required")),
    "recoverable_generation": lambda s, d: generations.recoverable(frame(s, d, "required"), frame(s, d, "required"), frame(s, d, "container_chunks").where("container_id <> 'c7'")),
    "required_anti": lambda s, d: dedup.missing(frame(s, d, "required"), frame(s, d, "entries").where("transition = 'ACTIVE' AND level = 0")),
    "container_classify": lambda s, d: _states(s, d)[2],
    "gc_plan": _gc,
    "priorities": lambda s, d: maintenance.priorities(frame(s, d, "pool_usage")).select("pool_id", "scrub", "gc"),
    "scrub_report": lambda s, d: maintenance.scrub_report(frame(s, d, "container_chunks"), frame(s, d, "required"), frame(s, d, "entries")),
    "hit_rate_bp": lambda s, d: report.hit_rate(frame(s, d, "accesses"), "cache"),
    "phase_percentiles": lambda s, d: report.latency(frame(s, d, "accesses"), "kind"),
    "encoding_decisions": _records,
    "checkpoint_trigger": lambda s, d: report.checkpoint_trigger(frame(s, d, "trigger_states")).select("event_id", "action", "wait_ms"),
    "handle_fence": lambda s, d: report.handle_fence(frame(s, d, "fence_events")),
    "directory_paging": lambda s, d: report.directory_page(_names(s, d), 1, 25),
    "reorder_rank": _reorder,
}

_NEW = "n AS (SELECT chunk_id, logical_length, container_id, record_offset, chunk_ordinal, max(struct_pack(g := generation, l := level, t := transition)) AS b FROM entries GROUP BY ALL)"
_ON = "o AS (SELECT DISTINCT chunk_id, logical_length FROM required WHERE generation IN (SELECT DISTINCT generation FROM required ORDER BY 1 DESC LIMIT 2))"
_ST = """st AS (SELECT container_id, count(*) AS chunks, CAST(count(o.chunk_id) AS BIGINT) AS live_chunks, CAST(sum(c.logical_length) + 383 * count(*) + 12351 AS BIGINT) AS bytes,
  CASE WHEN count(o.chunk_id) = 0 THEN 'RECLAIMABLE' WHEN count(o.chunk_id) < count(*) THEN 'PARTIAL' ELSE 'RETAINED' END AS state
  FROM container_chunks c LEFT JOIN o ON o.chunk_id = c.chunk_id AND o.logical_length = c.logical_length GROUP BY 1)"""
_TRANSITIONS = """p AS (SELECT generation, lag(generation) OVER w AS g, lag(mutation_sequence) OVER w AS m, lag(reservation_end) OVER w AS r, lag(allocation_cursor) OVER w AS c FROM roots WINDOW w AS (ORDER BY generation)),
b AS (SELECT x.*, g, m, r, c FROM roots x JOIN p USING (generation) WHERE g IS NOT NULL),
t AS (SELECT generation, 'MUTATION_BACK' AS fault, CAST(NULL AS BIGINT) AS inode FROM b WHERE mutation_sequence < m
  UNION ALL SELECT generation, 'RESERVATION_BACK', NULL FROM b WHERE reservation_end < r UNION ALL SELECT generation, 'ALLOCATION_BACK', NULL FROM b WHERE allocation_cursor < c
  UNION ALL SELECT generation, 'BEYOND_RESERVATION', NULL FROM b WHERE allocation_cursor > r
  UNION ALL SELECT i.generation, CASE WHEN q.inode IS NULL THEN 'REUSED_INODE' ELSE 'INODE_BACK' END, i.inode FROM root_inodes i JOIN b USING (generation)
    LEFT JOIN root_inodes q ON q.generation = b.g AND q.inode = i.inode WHERE (q.inode IS NULL AND i.inode < b.c) OR i.mutation_sequence < q.mutation_sequence)"""
_FAM = "f AS (SELECT level, generation % 13 AS family, count(*) AS entries, min(chunk_id) AS low, max(chunk_id) AS high FROM entries GROUP BY 1, 2)"
_LOG = """m AS (SELECT *, CASE WHEN torn THEN 'TORN' WHEN NOT checksum_ok THEN 'INVALID_RECORD' WHEN position = 1 THEN NULL WHEN generation <> lag(generation) OVER w + 1 THEN 'BROKEN_CHAIN'
  WHEN previous_hash IS DISTINCT FROM lag(record_hash) OVER w THEN 'BROKEN_CHAIN' WHEN mutation_cutoff < lag(mutation_cutoff) OVER w OR reservation_end < lag(reservation_end) OVER w OR allocation_cursor < lag(allocation_cursor) OVER w THEN 'BROKEN_CHAIN' END AS fault
  FROM commit_log WINDOW w AS (PARTITION BY log_id ORDER BY position)),
v AS (SELECT *, max(CASE WHEN fault IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY log_id ORDER BY position ROWS UNBOUNDED PRECEDING) = 0 AS valid FROM m)"""

ORACLES = {
    "run_merge_newest_wins": cte("entries") + f", {_NEW} SELECT chunk_id, logical_length, container_id, record_offset, chunk_ordinal, b.g AS generation, b.l AS level, b.t AS transition FROM n",
    "lookup_top64": cte("entries") + """, r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY generation DESC, level DESC, container_id, record_offset, chunk_ordinal, transition) AS rank, count(*) OVER (PARTITION BY chunk_id) AS n FROM entries)
SELECT chunk_id, count(*) AS found, bool_and(n < 64) AS complete, min(generation) AS oldest, CAST(sum(rank * generation) AS BIGINT) AS order_sum FROM r WHERE rank <= 64 GROUP BY chunk_id""",
    "candidate_two_active": cte("entries") + """, e AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY chunk_id, logical_length ORDER BY generation DESC, level DESC, container_id, record_offset, chunk_ordinal, transition) <= 64),
n AS (SELECT chunk_id, logical_length, container_id, record_offset, chunk_ordinal, max(struct_pack(g := generation, l := level, t := transition)) AS b FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, logical_length ORDER BY b.g DESC, container_id, record_offset, chunk_ordinal) AS k FROM n WHERE b.t = 'ACTIVE')
SELECT chunk_id, logical_length, string_agg(container_id || ':' || record_offset || ':' || chunk_ordinal, ',' ORDER BY k) AS candidates FROM r WHERE k <= 2 GROUP BY ALL""",
    "index_families": cte("entries") + f", {_FAM} SELECT * FROM f",
    "compaction_selection": cte("entries") + f""", {_FAM}, l AS (SELECT level FROM f GROUP BY level HAVING count(*) >= 4 ORDER BY level LIMIT 1)
SELECT level, family, CAST(k AS INTEGER) AS rank FROM (SELECT level, family, row_number() OVER (ORDER BY family) AS k FROM f JOIN l USING (level)) WHERE k <= 4""",
    "index_orphans": cte("entries", "container_chunks") + f""", {_NEW} SELECT DISTINCT container_id, chunk_id, logical_length FROM n WHERE b.t = 'ACTIVE'
  AND NOT EXISTS (SELECT 1 FROM container_chunks c WHERE c.container_id = n.container_id AND c.chunk_id = n.chunk_id AND c.logical_length = n.logical_length)""",
    "duplicate_locations": cte("entries") + " SELECT chunk_id, logical_length, container_id, record_offset, chunk_ordinal, level AS generation, count(*) AS n FROM entries GROUP BY ALL HAVING count(*) > 1",
    "length_conflicts": cte("extents") + " SELECT chunk_id, count(DISTINCT chunk_length) AS lengths, count(*) AS occurrences FROM extents GROUP BY 1 HAVING count(DISTINCT chunk_length) > 1",
    "commit_chain_check": cte("commit_log") + f", {_LOG} SELECT log_id, position, fault, valid FROM v",
    "commit_log_tail": cte("commit_log") + f", {_LOG} SELECT log_id, count(*) AS records, count(*) FILTER (valid) AS valid_records, max(generation) FILTER (valid) AS last_generation, coalesce(arg_min(fault, position) FILTER (fault IS NOT NULL), 'CLEAN') AS tail FROM v GROUP BY log_id",
    "generation_transitions": cte("roots", "root_inodes") + f", {_TRANSITIONS} SELECT * FROM t",
    "namespace_validation": cte("namespace_names") + """, c AS (SELECT target AS inode, count(*) AS n FROM namespace_names GROUP BY 1), i AS (SELECT inode, n + CASE WHEN inode % 19 = 0 THEN 1 ELSE 0 END AS link_count FROM c WHERE inode % 17 <> 0)
SELECT c.inode, CASE WHEN link_count IS NULL THEN 'DANGLING' ELSE 'LINK_COUNT' END AS fault FROM c LEFT JOIN i ON i.inode = c.inode WHERE link_count IS NULL OR link_count <> n""",
    "required_set": cte("extents") + " SELECT DISTINCT chunk_id, chunk_length AS logical_length FROM extents WHERE kind IN ('DATA', 'SLICE')",
    "online_set": cte("required") + f", {_ON} SELECT * FROM o",
    "new_requirements": cte("required") + " SELECT chunk_id, logical_length, min(generation) AS generation FROM required GROUP BY ALL",
    "recoverable_generation": cte("required", "container_chunks") + """, bad AS (SELECT DISTINCT generation FROM required r WHERE NOT EXISTS (SELECT 1 FROM container_chunks c WHERE c.container_id <> 'c7' AND c.chunk_id = r.chunk_id AND c.logical_length = r.logical_length))
SELECT max(generation) AS generation FROM required WHERE generation >= (SELECT max(generation) FROM required) - 1 AND generation NOT IN (SELECT generation FROM bad)""",
    "required_anti": cte("required", "entries") + " SELECT DISTINCT chunk_id, logical_length FROM required r WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE transition = 'ACTIVE' AND level = 0 AND e.chunk_id = r.chunk_id AND e.logical_length = r.logical_length)",
    "container_classify": cte("container_chunks", "required") + f", {_ON}, {_ST} SELECT * FROM st",
    "gc_plan": cte("container_chunks", "required") + f""", {_ON}, {_ST},
rep AS (SELECT chunk_id, logical_length FROM container_chunks JOIN o USING (chunk_id, logical_length) JOIN st USING (container_id) GROUP BY ALL HAVING NOT bool_or(state = 'RETAINED')),
r AS (SELECT count(*) AS replaced_chunks, CAST(coalesce(sum(logical_length), 0) AS BIGINT) AS replaced_bytes FROM rep),
s AS (SELECT count(*) FILTER (state = 'RECLAIMABLE') AS reclaimable, count(*) FILTER (state = 'PARTIAL') AS "partial", CAST(coalesce(sum(bytes) FILTER (state = 'RECLAIMABLE'), 0) AS BIGINT) AS reclaimable_bytes, CAST(coalesce(sum(bytes) FILTER (state = 'PARTIAL'), 0) AS BIGINT) AS partial_bytes FROM st),
b AS (SELECT *, CAST(CASE WHEN replaced_chunks = 0 THEN 0 ELSE replaced_bytes // 50069504 + replaced_chunks // 32768 + 1 END AS BIGINT) AS new_containers FROM s, r),
k AS (SELECT *, replaced_chunks = 0 OR ("partial" >= 2 AND new_containers < "partial") AS collect_partial, CAST(replaced_bytes + 383 * replaced_chunks + 12351 * new_containers AS BIGINT) AS replacement_bound FROM b)
SELECT *, CAST(reclaimable_bytes + CASE WHEN collect_partial THEN greatest(0, partial_bytes - replacement_bound) ELSE 0 END AS BIGINT) AS estimated_bytes FROM k""",
    "priorities": cte("pool_usage") + " SELECT pool_id, CASE WHEN used * 10 >= capacity * 9 THEN 'NORMAL' ELSE 'BACKGROUND' END AS scrub, CASE WHEN used * 10 >= capacity * 9 OR (container_bytes <> 0 AND reclaimable * 5 > container_bytes) THEN 'NORMAL' ELSE 'BACKGROUND' END AS gc FROM pool_usage",
    "scrub_report": cte("container_chunks", "required", "entries") + """
SELECT * FROM (SELECT count(DISTINCT container_id) AS containers, count(*) AS chunks, CAST(sum(logical_length) AS BIGINT) AS bytes FROM container_chunks),
  (SELECT count(DISTINCT generation) AS generations, max(generation) AS newest_generation FROM required), (SELECT count(*) FILTER (transition = 'ACTIVE') AS active_entries, max(generation) AS high_water FROM entries)""",
    "hit_rate_bp": cte("accesses") + " SELECT cache, count(*) AS accesses, count(*) FILTER (hit) AS hits, count(*) FILTER (hit) * 10000 // count(*) AS basis_points FROM accesses GROUP BY cache",
    "phase_percentiles": cte("accesses") + " SELECT kind, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99, max(latency_ms) AS worst FROM accesses GROUP BY kind",
    "encoding_decisions": cte("records") + """, x AS (SELECT *, raw_bytes - payload_bytes AS saved, (chunks - 1) * ((raw_bytes // chunks + 192 + 63) // 64 * 64) + (raw_bytes - raw_bytes // chunks * (chunks - 1) + 192 + 63) // 64 * 64 AS raw_record FROM records)
SELECT payload_bytes < raw_bytes AND saved >= 4096 AND saved * 100 >= raw_bytes * 3 AS zstd, saved >= 4096 AND saved * 100 >= raw_bytes * 5 AS delta, count(*) AS records,
  CAST(sum(CAST(ceil((payload_bytes + 128 + 64 * chunks) / 64) AS BIGINT) * 64) AS BIGINT) AS record_bytes,
  CAST(sum(greatest(0, greatest(0, raw_record - greatest(4096, (raw_record * 3 + 99) // 100)) // 64 * 64 - 128 - 64 * chunks)) AS BIGINT) AS payload_cap FROM x GROUP BY 1, 2""",
    "checkpoint_trigger": cte("trigger_states") + """, a AS (SELECT *, CASE WHEN dirty_age_ms >= 5000 THEN 'PAUSE_AND_COMMIT' WHEN sealed >= 8 OR dirty_age_ms >= 2000 OR container_age_ms >= 500 THEN 'COMMIT' ELSE 'WAIT' END AS action FROM trigger_states)
SELECT event_id, action, CASE WHEN action = 'WAIT' THEN greatest(0, least(2000 - dirty_age_ms, coalesce(500 - container_age_ms, 2000))) END AS wait_ms FROM a""",
    "handle_fence": cte("fence_events").replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY seq) AS k FROM fence_events),
f AS (SELECT handle, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS x FROM o WHERE k = 1
  UNION ALL SELECT o.handle, o.k, a + CASE WHEN op = 'accept' THEN 1 ELSE 0 END, c + CASE WHEN op = 'complete' AND "sequence" = c + 1 AND "sequence" <= a THEN 1 ELSE 0 END,
  x + CASE WHEN op = 'complete' AND NOT ("sequence" = c + 1 AND "sequence" <= a) THEN 1 ELSE 0 END FROM f JOIN o ON o.handle = f.handle AND o.k = f.k + 1)
SELECT handle, a AS accepted, c AS applied, x AS refused, a = c AS close_ready FROM f QUALIFY row_number() OVER (PARTITION BY handle ORDER BY k DESC) = 1""",
    "directory_paging": cte("namespace_names") + """, b AS (SELECT parent, name, 1 AS f FROM namespace_names UNION ALL SELECT DISTINCT parent, unnest(['.', '..']), 0 FROM namespace_names)
SELECT parent, name, cookie FROM (SELECT parent, name, row_number() OVER (PARTITION BY parent ORDER BY f, name) AS cookie FROM b) WHERE cookie > 1 AND cookie <= 26""",
    "reorder_rank": cte("extents") + """, r AS (SELECT file_id, ordinal, row_number() OVER (PARTITION BY file_id ORDER BY logical_offset // 16384, chunk_id, ordinal) - 1 AS place FROM extents)
SELECT file_id AS object_id, ordinal, place, place <> ordinal AS reordered FROM r""",
}
