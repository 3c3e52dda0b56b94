"""Queries on recipes and their bytes, lookups, compaction, collection, logs and slots, audits, and relational forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import chunking, dedup, encoding, generations, index, maintenance, report, similarity
from siltstone.operators import intervals as iv
from siltstone.plans.derive import cte, extents, frame
from siltstone.plans.interval_queries import _E
from siltstone.plans.state_queries import _NEW, _ON, _ST, _TRANSITIONS, _families, _files, _states

_PIECE = 512
#: A region of a whole source holds about so many bytes at most, a window of the engine.
SOURCE_BYTES = 64 << 20


def _chunks(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text")
    return chunking.with_chunk_id(chunking.fixed_chunks(chunking.objects(docs, "doc_id", "text", "lang"), _PIECE))


def _recipes(s, d):
    """Documents as recipes: of five pieces the fourth is a hole, the fifth a FILL."""
    c = _chunks(s, d)
    kind = F.when(F.col("ordinal") % 5 == 3, "HOLE").when(F.col("ordinal") % 5 == 4, "FILL").otherwise("DATA")
    long = lambda x: F.col(x).cast("long")
    recipes = c.select(F.col("object_id").alias("file_id"), "ordinal", long("input_offset").alias("logical_offset"), long("length").alias("length"), kind.alias("kind"), "chunk_id", F.lit(0).cast("long").alias("chunk_offset"), long("length").alias("chunk_length"), F.lit(65).alias("fill_value"))
    return recipes, c.groupBy("chunk_id").agg(F.min("bytes").alias("bytes"))


def _read(s, d):
    recipes, payload = _recipes(s, d)
    files = recipes.select("file_id").distinct()
    ranges = files.select("file_id", (F.col("file_id") % 7 * 100).cast("long").alias("range_start"), (F.col("file_id") % 7 * 100 + 3000 + F.when(F.col("file_id") % 50 == 0, 1 << 20).otherwise(0)).cast("long").alias("range_end"))
    got = iv.read_bytes(recipes, ranges, payload)
    return got.select("file_id", F.octet_length("bytes").cast("long").alias("length"), F.sha2("bytes", 256).alias("sha256"))


def _digest(df):
    """What a set of recipes comes to, by file: sizes, kinds and the sum of the places."""
    return df.groupBy("file_id").agg(F.count("*").alias("extents"), F.sum("length").alias("covered"), F.max(F.col("logical_offset") + F.col("length")).alias("size"), F.count_if(F.col("kind") == "SLICE").alias("slices"), F.sum(F.col("logical_offset") % 7919 * (F.col("chunk_offset") % 977 + 1)).alias("places"))


_DIGEST = "file_id, count(*) AS extents, CAST(sum(length) AS BIGINT) AS covered, max(logical_offset + length) AS size, count(*) FILTER (kind = 'SLICE') AS slices, CAST(sum(logical_offset % 7919 * (chunk_offset % 977 + 1)) AS BIGINT) AS places"


def _new(s, d, table="ranges"):
    """Two extents for each file of a table: a FILL of 300 bytes and a HOLE of 200 and more."""
    r = frame(s, d, table).select("file_id").distinct()
    row = lambda at, n, kind: F.struct(F.lit(at).cast("long").alias("logical_offset"), n.cast("long").alias("length"), F.lit(kind).alias("kind"))
    parts = F.explode(F.array(row(0, F.lit(300), "FILL"), row(300, F.lit(200) + F.col("file_id") % 3 * 2250, "HOLE")))
    return r.select("file_id", parts.alias("e")).select("file_id", "e.*", F.lit(None).cast("string").alias("chunk_id"), F.lit(0).cast("long").alias("chunk_offset"), F.lit(0).cast("long").alias("chunk_length"))


_N = """n AS (SELECT file_id, CAST(0 AS BIGINT) AS logical_offset, CAST(300 AS BIGINT) AS length, 'FILL' AS kind FROM ranges UNION ALL SELECT file_id, 300, 200 + file_id % 3 * 2250, 'HOLE' FROM ranges)"""


def _rewrite_sql(where: str) -> str:
    cut = "CASE WHEN kind = 'DATA' AND ({0}) THEN 'SLICE' ELSE kind END"
    return cte("extents", "ranges") + f""", {_N}, l AS (SELECT file_id, 500 + file_id % 3 * 2250 AS n FROM ranges),
z AS (SELECT file_id, range_start AS a, range_end AS b, n - (range_end - range_start) AS m FROM ranges JOIN l USING (file_id) JOIN (SELECT file_id, max({_E}) AS fe FROM extents GROUP BY 1) USING (file_id) WHERE b <= fe {where}),
x AS (SELECT file_id, logical_offset, least({_E}, a) - logical_offset AS length, {cut.format(f"{_E} > a")} AS kind, chunk_offset FROM extents JOIN z USING (file_id) WHERE logical_offset < a
  UNION ALL SELECT file_id, logical_offset + a, length, kind, 0 FROM n JOIN z USING (file_id)
  UNION ALL SELECT file_id, greatest(logical_offset, b) + m, {_E} - greatest(logical_offset, b), {cut.format("logical_offset < b")}, chunk_offset + greatest(0, b - logical_offset) FROM extents JOIN z USING (file_id) WHERE {_E} > b
  UNION ALL SELECT file_id, logical_offset, length, kind, chunk_offset FROM extents WHERE file_id NOT IN (SELECT file_id FROM z))
SELECT {_DIGEST} FROM x GROUP BY file_id"""


def _layers(s, d):
    w = frame(s, d, "writes")
    return iv.layered_read(w.select("file_id", (F.col("seq") % 3).alias("layer"), "seq", "range_start", "range_end"))


def _slots(s, d):
    """The two slots of each log: A has its first records, B goes on from the last of these; some are as long as A, or overlap, or are missing."""
    log = frame(s, d, "commit_log").where("checksum_ok AND NOT torn")
    tail = lambda rows, salt: rows.groupBy("log_id").agg(
        F.min("position").alias("first_generation"), F.max("position").alias("last_generation"), F.count("*").alias("records"), F.max_by("record_hash", "position").alias("last_hash"), F.min_by("record_hash", "position").alias("first_hash"),
        F.concat(F.lit(salt), F.max("record_hash")).alias("bytes_hash"), F.when(F.col("log_id") % 4 == 0, "TORN").otherwise("CLEAN").alias("tail"),
    )
    a = tail(log.where("position <= 5 + log_id % 3"), "x")
    last = F.when(F.col("log_id") % 5 == 1, 5 + F.col("log_id") % 3).otherwise(1 << 40)
    b = tail(log.where((F.col("position") >= F.when(F.col("log_id") % 5 == 2, 4).otherwise(5 + F.col("log_id") % 3)) & (F.col("position") <= last) & (F.col("log_id") % 5 != 3)), "y")
    return generations.select_slot(a, b)


def _victims(s, d):
    chunks, online, _ = _states(s, d)
    return chunks, online, maintenance.collect_garbage(chunks, online, _files(chunks), "pool", 7)


def _containers(s, d):
    _, _, after = _victims(s, d)
    return after.groupBy("origin").agg(F.count("*").alias("rows"), F.countDistinct("container_id").alias("containers"), F.countDistinct("chunk_id", "logical_length").alias("chunks"), F.sum("logical_length").alias("bytes"))


def _batches(s, d):
    chunks, online, states = _states(s, d)
    replaced = maintenance.replacement_set(chunks, online, states)
    order = maintenance.replacement_order(chunks, replaced, states.where("state = 'PARTIAL'"))
    return maintenance.replacement_batches(order, 1 << 20, 100).groupBy("batch").agg(F.count("*").alias("chunks"), F.sum("logical_length").alias("bytes"), F.min("container_id").alias("first"))


def _entries(s, d):
    return frame(s, d, "entries").withColumn("family", F.col("generation") % 13)


def _compacted(s, d):
    e = _entries(s, d)
    chosen = index.compaction_selection(index.families(e))
    after = index.compact(e, chosen, 100)
    return after.groupBy("level", "family").agg(F.count("*").alias("entries"), F.max("generation").alias("newest"), F.count_if(F.col("transition") == "ACTIVE").alias("active"))


def _published(s, d):
    e = _entries(s, d)
    return index.families(index.publish(e.where("level > 0"), e.where("level = 0"), 100)).select("level", "family", "entries")


def _audit(s, d):
    """Records of document pieces with a checksum; some payloads, places and ids are spoilt."""
    c = _chunks(s, d).select(F.col("object_id").cast("long").alias("container_id"), F.col("ordinal").cast("long").alias("chunk_ordinal"), "chunk_id", F.col("length").cast("long").alias("logical_length"), "bytes")
    n = F.col("container_id") * 31 + F.col("chunk_ordinal")
    payload = c.where(n % 101 != 0).withColumn("bytes", F.when(n % 89 == 0, F.encode(F.lit("spoilt"), "UTF-8")).when(n % 97 == 0, F.encode(F.repeat(F.lit("x"), F.col("logical_length").cast("int")), "UTF-8")).otherwise(F.col("bytes")))
    return c, payload


def _locations(s, d):
    places, payload = _audit(s, d)
    return encoding.location_faults(places.drop("bytes"), payload).select("container_id", "chunk_ordinal", "fault")


def _checksums(s, d):
    good, spoilt = _audit(s, d)
    sums = encoding.with_checksum(good.withColumnRenamed("bytes", "payload")).select("container_id", "chunk_ordinal", "checksum")
    return encoding.checksum_faults(spoilt.withColumnRenamed("bytes", "payload").join(sums, ["container_id", "chunk_ordinal"])).select("container_id", "chunk_ordinal", "checksum")


def gate_regions(s, d):
    """Large regions, whole sources, and random ones: each outcome of the gate occurs. A source of over ``SOURCE_BYTES`` is dealt over several regions by its documents."""
    docs = s.read.parquet(f"{d}/documents.parquet")
    # The noise of a source is seeded with the length of its texts, joined; a column of its own, as a lambda would work it out anew for each hash.
    sums = docs.groupBy("source").agg((F.coalesce(F.sum(F.length("text")), F.lit(0)) + F.greatest(F.count("text") - 1, F.lit(0))).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    large = sums.where(F.col("size") > SOURCE_BYTES).select(F.col("source").alias("_source"), F.ceil(F.col("size") / SOURCE_BYTES).alias("parts"))  # a row for each SOURCE_BYTES at most
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", "text"), F.col("parts")), F.lit(0)).alias("part")
    dealt = docs.join(F.broadcast(large), F.col("source").eqNullSafe(F.col("_source")), "left").select("source", part, "text")
    text = dealt.groupBy("source", "part").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("t"))
    plain = text.select(F.concat(F.lit("text-"), F.coalesce("source", F.lit(""))).alias("region"), F.encode("t", "UTF-8").alias("bytes"))
    noise = sums.select(F.concat(F.lit("noise-"), F.coalesce("source", F.lit(""))).alias("region"), F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4999)), lambda i: F.sha2(F.concat_ws(":", "n", "source", i).cast("binary"), 256)), "")).alias("bytes"))
    small = docs.select(F.concat(F.lit("small-"), F.col("doc_id")).alias("region"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))
    rows = plain.unionByName(noise).unionByName(small).withColumn("chunks", F.lit(1))
    return rows.where("octet_length(bytes) > 0")


def _gate(s, d):
    return encoding.gate_metrics(encoding.gate(gate_regions(s, d)), F.split_part("region", F.lit("-"), F.lit(1)).alias("kind"))


def _costs(s, d):
    r = frame(s, d, "records").select(F.concat_ws(":", "record_id", "line").alias("region"), "raw_bytes", "payload_bytes", "chunks").groupBy("region").agg(*[F.max(x).alias(x) for x in ("raw_bytes", "payload_bytes", "chunks")])
    trial = lambda name, size, extra: r.select("region", F.lit(name).alias("encoding"), size.alias("payload_bytes"), extra.cast("long").alias("overhead"))
    trials = trial("RAW", F.col("raw_bytes"), 192 * F.col("chunks")).unionByName(trial("ZSTD", F.col("payload_bytes"), 128 + 64 * F.col("chunks"))).unionByName(trial("DICTIONARY", F.col("payload_bytes") - F.col("chunks") * 100, F.lit(900)))
    return encoding.candidate_costs(trials).groupBy("encoding").agg(F.count("*").alias("regions"), F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected"), F.sum("rejected_bytes").alias("rejected_bytes"))


def _index_audit(s, d):
    e = frame(s, d, "extents")
    prints = e.select("chunk_id", F.col("chunk_length").alias("length"), F.array(F.substring("chunk_id", 1, 8), F.substring("chunk_id", 9, 8)).alias("features"))
    have = prints.select("chunk_id", "length", F.posexplode("features").alias("slot", "feature")).where(F.conv(F.substring("chunk_id", 1, 2), 16, 10).cast("int") % 9 != 0)
    extra = have.where("slot = 1").withColumn("slot", F.lit(2)).where(F.substring("chunk_id", 3, 1) == "a")
    return similarity.index_faults(prints, have.unionByName(extra)).groupBy("slot", "fault").agg(F.count("*").alias("postings"))


def _as_of(s, d):
    """For each order the last event of its customer up to a number taken from the order: a union, ordered, and the last value carried on."""
    o = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").cast("long").alias("k"), (F.col("o_orderkey") * 3 % 5000).cast("long").alias("at"), F.col("o_orderkey").cast("long").alias("order_id"), F.lit(None).cast("long").alias("event_id"))
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("long").alias("k"), F.col("event_id").cast("long").alias("at"), F.lit(None).cast("long").alias("order_id"), F.col("event_id").cast("long").alias("event_id"))
    by = Window.partitionBy("k").orderBy("at", F.col("order_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return o.unionByName(e).withColumn("event_id", F.last("event_id", ignorenulls=True).over(by)).where("order_id IS NOT NULL").select("order_id", "event_id")


def _restored(s, d):
    c = _chunks(s, d).select("object_id", "ordinal", "chunk_id", "length", "bytes")
    recipes = dedup.recipe(c.drop("bytes"))
    payload = c.groupBy("chunk_id", "length").agg(F.min("bytes").alias("bytes"))
    return dedup.restore(recipes, payload).select("object_id", F.sha2("bytes", 256).alias("sha256"), "verified")


def _owner_index(s, d):
    return dedup.owners(_chunks(s, d).drop("bytes"))


def _lookups(s, d):
    owners = _owner_index(s, d).select("chunk_id", F.concat_ws(":", "owner_object", "owner_ordinal").alias("location"))
    keys = _chunks(s, d).select(F.col("chunk_id").alias("key"))
    part = lambda k: owners.where(F.conv(F.substring("chunk_id", 1, 2), 16, 10).cast("int") % 4 == k).select(F.col("chunk_id").alias("key"), "location")
    return dedup.batched_lookup(keys, part(0), part(1).unionByName(part(0).withColumn("location", F.lit("old")))).groupBy("source").agg(F.count("*").alias("keys"), F.max("location").alias("last"))


def _fallback(s, d):
    owners = _owner_index(s, d).select("chunk_id", F.concat_ws(":", "owner_object", "owner_ordinal").alias("location"))
    first = F.conv(F.substring("chunk_id", 1, 2), 16, 10).cast("int")
    found = index.lookup_with_fallback(owners.select("chunk_id"), owners.where(first % 3 == 0), owners.where(first % 3 < 2))
    return found.groupBy("source").agg(F.count("*").alias("keys"), F.max("location").alias("last"))


def _approximate(s, d):
    """Distinct users by event type, and whether the sketch is within 5 %."""
    e = s.read.parquet(f"{d}/events.parquet")
    # Apart from each other: beside a distinct count a sketch would be kept for each user.
    near = e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("near")).withColumnRenamed("event_type", "_type")
    sums = e.groupBy("event_type").agg(F.countDistinct("user_id").alias("users")).join(near, F.col("event_type").eqNullSafe(F.col("_type")))
    return sums.select("event_type", "users", (F.abs(F.col("near") - F.col("users")) <= 0.05 * F.col("users") + 1).alias("close"))


def _run(s, d):
    """A run of at least four ranges: whether each partition is sorted and no chunk id is in two."""
    run = index.run_sorted(_entries(s, d).select(*index.LOCATION, "generation"), 4).withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id())
    by = Window.partitionBy("p").orderBy("i")
    marked = run.withColumn("sorted", F.coalesce(F.lag("chunk_id").over(by) <= F.col("chunk_id"), F.lit(True)))
    parts = marked.groupBy("p").agg(F.count("*").alias("n"), F.bool_and("sorted").alias("sorted"), F.countDistinct("chunk_id").alias("ids"))
    return parts.agg(F.sum("n").alias("entries"), F.bool_and("sorted").alias("sorted"), F.sum("ids").alias("ids"))


def _plan_current(s, d):
    log = frame(s, d, "commit_log").select((F.col("log_id") * 1_000_000_000 + F.col("position")).alias("generation"), "record_hash")
    return generations.plan_is_current(log.orderBy(F.col("generation").desc()).limit(2), log)


def _successors(s, d):
    log = frame(s, d, "commit_log")
    log = log.withColumn("end", F.max("position").over(Window.partitionBy("log_id")))
    first = log.where("position = 1")
    return generations.successor_faults(log.where("position < end"), log.where("position = end").unionByName(first).unionByName(first.withColumn("log_id", F.col("log_id") + 100)))


def _names(s, d):
    n = frame(s, d, "namespace_names")
    odd = F.when(F.col("target") % 41 == 0, "..").when(F.col("target") % 43 == 0, "a/b").when(F.col("target") % 47 == 0, F.repeat(F.lit("n"), 256)).when(F.col("target") % 53 == 0, "").otherwise(F.concat(F.lit("n"), F.col("target") % 60))
    return generations.name_faults(n.select(F.when(F.col("target") % 11 == 0, 2).otherwise(1).alias("parent"), odd.alias("name"), "target")).groupBy("fault").agg(F.count("*").alias("names"), F.max("target").alias("last"))


QUERIES = {
    "read_bytes": _read,
    "cloned_extents": lambda s, d: iv.cloned_extents(extents(s, d), frame(s, d, "clones")),
    "clone_status": lambda s, d: iv.clone_range(extents(s, d), frame(s, d, "clones")).select("clone_id", "status"),
    "rewrite_range": lambda s, d: _digest(iv.rewrite(extents(s, d), frame(s, d, "ranges"), _new(s, d))),
    "splice_range": lambda s, d: _digest(iv.rewrite(extents(s, d), frame(s, d, "ranges"), _new(s, d), resize=True)),
    "append_extents": lambda s, d: _digest(iv.append(extents(s, d).drop("ordinal"), _new(s, d))),
    "layered_read": _layers,
    "restore_objects": _restored,
    "index_insert": lambda s, d: dedup.insert_no_replace(_owner_index(s, d).where("owner_object % 2 = 0"), _chunks(s, d).select("chunk_id", "length", F.col("lang").alias("place"))).select("chunk_id", "length"),
    "batched_lookup": _lookups,
    "lookup_fallback": _fallback,
    "reuse_opportunity": lambda s, d: dedup.reuse_opportunity(_chunks(s, d).drop("bytes"), "lang"),
    "object_digests": lambda s, d: dedup.object_digest(_chunks(s, d).drop("bytes")),
    "matrix_rollup": lambda s, d: report.rollup(extents(s, d).withColumn("w", F.col("ordinal") % 3), "kind", "w"),
    "index_rebuild": lambda s, d: index.rebuild(frame(s, d, "container_chunks").withColumn("record_offset", F.col("chunk_ordinal") * 64), 5).groupBy("container_id").agg(F.count("*").alias("entries"), F.sum("record_offset").alias("offsets"), F.max("generation").alias("generation")),
    "run_build": _run,
    "compact_families": _compacted,
    "publish_run": _published,
    "partition_cuts": lambda s, d: index.partition_cuts(_entries(s, d), 500),
    "partition_overlaps": lambda s, d: index.overlapping_partitions(index.partition_cuts(_entries(s, d), 500).unionByName(index.partition_cuts(_entries(s, d), 900)).select("family", "low", "high")),
    "replacement_batches": _batches,
    "collect_garbage": _containers,
    "collection_faults": lambda s, d: (lambda c, o, a: maintenance.collection_faults(c, a, o))(*_victims(s, d)),
    "slot_selection": _slots,
    "slot_rotation": lambda s, d: generations.rotate(frame(s, d, "commit_log").select("log_id", "position", "record_hash"), 8).select("log_id", "slot", "turn", "slot_position", "record_hash"),
    "log_successors": _successors,
    "valid_prefix": lambda s, d: generations.valid_prefix(frame(s, d, "roots"), frame(s, d, "root_inodes")),
    "root_faults": lambda s, d: generations.root_faults(frame(s, d, "roots"), frame(s, d, "root_inodes")),
    "name_faults": _names,
    "plan_is_current": _plan_current,
    "reorder_excess": lambda s, d: report.reorder_excess(report.reorder_rank(extents(s, d).select(F.col("file_id").alias("object_id"), "ordinal", F.lit(0).alias("window"), F.col("chunk_id").alias("features"))), 3).select("object_id", "ordinal", "moved"),
    "phase_metrics": lambda s, d: report.phase_metrics(frame(s, d, "phases"), "checkpoint"),
    "result_rows": lambda s, d: report.result_rows(frame(s, d, "records").groupBy(F.col("chunks").cast("string").alias("policy")).agg(F.sum("raw_bytes").alias("logical_bytes"), F.sum("payload_bytes").alias("payload_bytes"), F.sum(F.col("line") * 512).alias("exact_hit_bytes"))),
    "location_faults": _locations,
    "checksum_faults": _checksums,
    "gate_metrics": _gate,
    "candidate_costs": _costs,
    "similarity_index_audit": _index_audit,
    "as_of_join": _as_of,
    "approximate_distinct": _approximate,
    "common_chunks": lambda s, d: frame(s, d, "required").where("generation % 2 = 0").select("chunk_id").intersect(frame(s, d, "container_chunks").where("chunk_ordinal = 1").select("chunk_id")),
    "unused_chunks": lambda s, d: frame(s, d, "container_chunks").select("chunk_id", "logical_length").exceptAll(frame(s, d, "required").where("generation % 5 <> 0").select("chunk_id", "logical_length")).groupBy("chunk_id").agg(F.count("*").alias("n")),
}

_D = "d AS (SELECT doc_id, lang, encode(text) AS b FROM documents WHERE text <> '')"
_C = f"{_D}, c AS (SELECT doc_id, lang, o // {_PIECE} AS i, o, p, octet_length(p) AS n, sha256(p) AS h FROM (SELECT doc_id, lang, o, array_slice(b, o + 1, o + {_PIECE}) AS p FROM (SELECT *, unnest(range(0, octet_length(b), {_PIECE})) AS o FROM d)))"
_O = f"{_C}, w AS (SELECT h, n, min(struct_pack(a := doc_id, b := i)) AS s FROM c GROUP BY h, n), x AS (SELECT h, s.a || ':' || s.b AS loc, s.a AS obj, CAST('0x' || h[1:2] AS INTEGER) AS f FROM w)"
_F = "e AS (SELECT *, generation % 13 AS family FROM entries)"
_LIVE = f"""{_ON}, {_ST}, rep AS (SELECT chunk_id, logical_length FROM container_chunks JOIN o USING (chunk_id, logical_length) JOIN st USING (container_id) GROUP BY ALL HAVING NOT bool_or(state = 'RETAINED')),
g AS (SELECT count(*) AS rc, coalesce(sum(logical_length), 0) AS rb FROM rep),
k AS (SELECT rc = 0 OR (np >= 2 AND rb // 50069504 + rc // 32768 + 1 < np) AS collect FROM g, (SELECT count(*) FILTER (state = 'PARTIAL') AS np FROM st)),
v AS (SELECT container_id FROM st, k WHERE state = 'RECLAIMABLE' OR (state = 'PARTIAL' AND collect))"""
_FIRST = """SELECT min(struct_pack(c := container_id, i := chunk_ordinal)) AS f, chunk_id, logical_length FROM container_chunks JOIN rep USING (chunk_id, logical_length) JOIN st USING (container_id) WHERE state = 'PARTIAL' GROUP BY chunk_id, logical_length"""
_CLONES = cte("extents", "clones") + f""", fe AS (SELECT file_id, max({_E}) AS fe FROM extents GROUP BY 1),
s AS (SELECT q.*, CASE WHEN length > 0 AND source_file = target_file AND abs(source_offset - target_offset) < length THEN 'UNSUPPORTED' WHEN length = 0 THEN 'OK' WHEN source_offset + length > coalesce(fe, 0) THEN 'INVALID'
  WHEN EXISTS (SELECT 1 FROM extents x WHERE x.file_id = q.source_file AND kind = 'HOLE' AND x.logical_offset < q.source_offset + q.length AND x.logical_offset + x.length > q.source_offset) THEN 'UNSUPPORTED' ELSE 'OK' END AS status
  FROM clones q LEFT JOIN fe ON fe.file_id = source_file)"""

ORACLES = {
    "read_bytes": f"""WITH {_C}, r AS (SELECT DISTINCT doc_id AS file_id, doc_id % 7 * 100 AS a, doc_id % 7 * 100 + 3000 AS z, doc_id % 50 = 0 AS large FROM c),
p AS (SELECT file_id, o, greatest(o, a) AS s, least(o + n, z) AS e, CASE WHEN i % 5 = 3 THEN repeat('00', CAST(least(o + n, z) - greatest(o, a) AS INTEGER)) WHEN i % 5 = 4 THEN repeat('41', CAST(least(o + n, z) - greatest(o, a) AS INTEGER))
  ELSE hex(array_slice(p, greatest(o, a) - o + 1, least(o + n, z) - o)) END AS x FROM c JOIN r ON r.file_id = c.doc_id WHERE o < z AND o + n > a),
g AS (SELECT file_id, string_agg(x, '' ORDER BY o) AS x FROM p GROUP BY file_id)
SELECT file_id, CASE WHEN NOT large THEN coalesce(CAST(length(x) // 2 AS BIGINT), 0) END AS length, CASE WHEN NOT large THEN sha256(unhex(coalesce(x, ''))) END AS sha256 FROM r LEFT JOIN g USING (file_id)""",
    "cloned_extents": _CLONES + f""", h AS (SELECT clone_id, target_file, target_offset, source_offset AS a, source_offset + length AS z, source_file AS file_id FROM s WHERE status = 'OK' AND length > 0)
SELECT clone_id, target_file AS file_id, target_offset + greatest(logical_offset, a) - a AS logical_offset, least({_E}, z) - greatest(logical_offset, a) AS length,
  CASE WHEN kind = 'DATA' AND (logical_offset < a OR {_E} > z) THEN 'SLICE' ELSE kind END AS kind, chunk_id, chunk_offset + greatest(0, a - logical_offset) AS chunk_offset, chunk_length
FROM extents JOIN h USING (file_id) WHERE logical_offset < z AND {_E} > a""",
    "clone_status": _CLONES + " SELECT clone_id, status FROM s",
    "rewrite_range": _rewrite_sql("AND n = range_end - range_start"),
    "splice_range": _rewrite_sql(""),
    "append_extents": cte("extents", "ranges") + f""", {_N}, fe AS (SELECT file_id, max({_E}) AS fe FROM extents GROUP BY 1),
x AS (SELECT file_id, logical_offset, length, kind, chunk_offset FROM extents UNION ALL SELECT file_id, logical_offset + coalesce(fe, 0), length, kind, 0 FROM n LEFT JOIN fe USING (file_id)) SELECT {_DIGEST} FROM x GROUP BY file_id""",
    "layered_read": cte("writes") + """, q AS (SELECT *, seq % 3 AS layer FROM writes), p AS (SELECT file_id, range_start AS a FROM q UNION SELECT file_id, range_end FROM q),
c AS (SELECT file_id, a, lead(a) OVER (PARTITION BY file_id ORDER BY a) AS b FROM p),
w AS (SELECT c.file_id, a, b, max(struct_pack(l := layer, s := seq)) AS t FROM c JOIN q ON q.file_id = c.file_id AND range_start <= a AND range_end >= b GROUP BY ALL),
f AS (SELECT *, CASE WHEN lag(t) OVER k = t AND lag(b) OVER k = a THEN 0 ELSE 1 END AS n FROM w WINDOW k AS (PARTITION BY file_id ORDER BY a)),
r AS (SELECT *, sum(n) OVER (PARTITION BY file_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT file_id, t.l AS layer, t.s AS seq, min(a) AS range_start, max(b) AS range_end FROM r GROUP BY file_id, run, t""",
    "restore_objects": f"WITH {_D} SELECT doc_id AS object_id, sha256(b) AS sha256, true AS verified FROM d",
    "index_insert": f"WITH {_O} SELECT h AS chunk_id, n AS length FROM w WHERE s.a % 2 <> 0",
    "batched_lookup": f"WITH {_O} SELECT CASE f % 4 WHEN 0 THEN 'cache' WHEN 1 THEN 'index' ELSE 'none' END AS source, count(*) AS keys, max(CASE WHEN f % 4 < 2 THEN loc END) AS last FROM x GROUP BY 1",
    "lookup_fallback": f"WITH {_O} SELECT CASE f % 3 WHEN 0 THEN 'index' WHEN 1 THEN 'scan' END AS source, count(*) AS keys, max(CASE WHEN f % 3 < 2 THEN loc END) AS last FROM x GROUP BY 1",
    "reuse_opportunity": f"WITH {_C}, u AS (SELECT lang, h, n, count(*) AS k FROM c GROUP BY ALL) SELECT lang, CAST(sum(k) AS BIGINT) AS chunks, count(*) AS distinct_chunks, CAST(sum(k) - count(*) AS BIGINT) AS reusable_chunks, CAST(sum((k - 1) * n) AS BIGINT) AS reusable_bytes FROM u GROUP BY lang",
    "object_digests": f"WITH {_C} SELECT doc_id AS object_id, sha256(string_agg(h, ',' ORDER BY i)) AS digest FROM c GROUP BY doc_id",
    "matrix_rollup": cte("extents") + " SELECT kind, ordinal % 3 AS w, CAST(grouping(kind, ordinal % 3) AS BIGINT) AS level, count(*) AS chunks, CAST(sum(length) AS BIGINT) AS bytes FROM extents GROUP BY ROLLUP (kind, ordinal % 3)",
    "index_rebuild": cte("container_chunks") + " SELECT container_id, count(*) AS entries, CAST(sum(chunk_ordinal * 64) AS BIGINT) AS offsets, CAST(5 AS BIGINT) AS generation FROM container_chunks GROUP BY 1",
    "run_build": cte("entries") + " SELECT count(*) AS entries, true AS sorted, count(DISTINCT chunk_id) AS ids FROM entries",
    "compact_families": cte("entries") + f""", {_F}, f AS (SELECT level, family FROM e GROUP BY ALL), l AS (SELECT level FROM f GROUP BY level HAVING count(*) >= 4 ORDER BY level LIMIT 1),
c AS (SELECT level, family FROM f JOIN l USING (level) ORDER BY family LIMIT 4),
m AS (SELECT max(struct_pack(g := generation, x := family, l := level, t := transition)) AS b FROM e JOIN c USING (level, family) GROUP BY chunk_id, logical_length, container_id, record_offset, chunk_ordinal),
u AS (SELECT level, family, generation, transition FROM e WHERE (level, family) NOT IN (SELECT (level, family) FROM c) UNION ALL SELECT b.l + 1, 100, b.g, b.t FROM m)
SELECT level, family, count(*) AS entries, max(generation) AS newest, count(*) FILTER (transition = 'ACTIVE') AS active FROM u GROUP BY ALL""",
    "partition_cuts": cte("entries").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_F}, k AS (SELECT family, chunk_id, count(*) AS n, row_number() OVER (PARTITION BY family ORDER BY chunk_id) AS i FROM e GROUP BY family, chunk_id),
p AS (SELECT family, chunk_id, i, CAST(0 AS BIGINT) AS part, n AS total, n FROM k WHERE i = 1
  UNION ALL SELECT k.family, k.chunk_id, k.i, CASE WHEN total >= 500 THEN part + 1 ELSE part END, CASE WHEN total >= 500 THEN k.n ELSE total + k.n END, k.n FROM p JOIN k ON k.family = p.family AND k.i = p.i + 1)
SELECT family, part AS partition, CAST(sum(n) AS BIGINT) AS entries, min(chunk_id) AS low, max(chunk_id) AS high FROM p GROUP BY family, part""",
    "replacement_batches": cte("container_chunks", "required").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_LIVE}, q AS ({_FIRST}), y AS (SELECT f.c AS container_id, logical_length AS n, row_number() OVER (ORDER BY f, chunk_id, logical_length) AS i FROM q),
p AS (SELECT i, container_id, n, CAST(0 AS BIGINT) AS batch, n AS total, 1 AS k FROM y WHERE i = 1
  UNION ALL SELECT y.i, y.container_id, y.n, CASE WHEN total + y.n > 1048576 OR k >= 100 THEN batch + 1 ELSE batch END, CASE WHEN total + y.n > 1048576 OR k >= 100 THEN y.n ELSE total + y.n END, CASE WHEN total + y.n > 1048576 OR k >= 100 THEN 1 ELSE k + 1 END FROM p JOIN y ON y.i = p.i + 1)
SELECT batch, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS bytes, min(container_id) AS first FROM p GROUP BY batch""",
    "collect_garbage": cte("container_chunks", "required") + f""", {_LIVE}, a AS (SELECT 'KEPT' AS origin, container_id, chunk_id, logical_length FROM container_chunks WHERE container_id NOT IN (SELECT container_id FROM v)
  UNION ALL SELECT 'NEW', 'new', chunk_id, logical_length FROM ({_FIRST}), k WHERE collect)
SELECT origin, count(*) AS "rows", count(DISTINCT container_id) AS containers, count(DISTINCT (chunk_id, logical_length)) AS chunks, CAST(sum(logical_length) AS BIGINT) AS bytes FROM a GROUP BY origin""",
    "collection_faults": cte("required") + " SELECT chunk_id, logical_length FROM required WHERE false",
    "slot_selection": cte("commit_log") + """, l AS (SELECT * FROM commit_log WHERE checksum_ok AND NOT torn),
a AS (SELECT log_id, min(position) AS f, max(position) AS g, count(*) AS n, arg_max(record_hash, position) AS h, arg_min(record_hash, position) AS i, 'x' || max(record_hash) AS b FROM l WHERE position <= 5 + log_id % 3 GROUP BY 1),
b AS (SELECT log_id, min(position) AS f, max(position) AS g, count(*) AS n, arg_max(record_hash, position) AS h, arg_min(record_hash, position) AS i, 'y' || max(record_hash) AS b FROM l
  WHERE position >= CASE WHEN log_id % 5 = 2 THEN 4 ELSE 5 + log_id % 3 END AND position <= CASE WHEN log_id % 5 = 1 THEN 5 + log_id % 3 ELSE 1000000000 END AND log_id % 5 <> 3 GROUP BY 1)
SELECT log_id, CASE WHEN b.n IS NULL THEN 'A' WHEN a.n IS NULL THEN 'B' WHEN a.g = b.g THEN CASE WHEN a.h <> b.h THEN 'CONFLICT' WHEN a.n > b.n THEN 'A' WHEN b.n > a.n THEN 'B' WHEN a.b <> b.b THEN 'CONFLICT' WHEN log_id % 4 = 0 THEN 'B' ELSE 'A' END
  WHEN a.g > b.g THEN CASE WHEN a.i = b.h THEN 'A' ELSE 'CONFLICT' END ELSE CASE WHEN b.i = a.h THEN 'B' ELSE 'CONFLICT' END END AS slot FROM a FULL JOIN b USING (log_id)""",
    "slot_rotation": cte("commit_log") + """, r AS (SELECT log_id, position, record_hash, row_number() OVER (PARTITION BY log_id ORDER BY position) - 1 AS p FROM commit_log),
t AS (SELECT log_id, record_hash, CASE WHEN p = 0 THEN 0 ELSE (p - 1) // 7 END AS turn, CASE WHEN p = 0 THEN 0 ELSE (p - 1) % 7 + 1 END AS k FROM r),
u AS (SELECT log_id, turn, k, record_hash FROM t UNION ALL SELECT log_id, turn + 1, 0, record_hash FROM (SELECT *, max(turn) OVER (PARTITION BY log_id) AS z FROM t) WHERE k = 7 AND turn < z)
SELECT log_id, CASE WHEN turn % 2 = 0 THEN 'A' ELSE 'B' END AS slot, turn, k AS slot_position, record_hash FROM u""",
    "log_successors": cte("commit_log") + """, z AS (SELECT *, max(position) OVER (PARTITION BY log_id) AS z FROM commit_log), l AS (SELECT * FROM z WHERE position < z QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY position DESC) = 1),
n AS (SELECT * EXCLUDE (z) FROM z WHERE position = z UNION ALL SELECT * FROM commit_log WHERE position = 1 UNION ALL SELECT * REPLACE (log_id + 100 AS log_id) FROM commit_log WHERE position = 1)
SELECT n.log_id, CASE WHEN l.log_id IS NULL THEN CASE WHEN n.generation = 1 AND n.previous_hash IS NULL THEN NULL ELSE 'BROKEN_CHAIN' END
  WHEN n.generation = l.generation + 1 AND n.previous_hash IS NOT DISTINCT FROM l.record_hash AND n.mutation_cutoff >= l.mutation_cutoff AND n.reservation_end >= l.reservation_end AND n.allocation_cursor >= l.allocation_cursor THEN NULL ELSE 'BROKEN_CHAIN' END AS fault
FROM n LEFT JOIN l USING (log_id)""",
    "valid_prefix": cte("roots", "root_inodes") + f""", {_TRANSITIONS}, z AS (SELECT min(generation) AS z FROM (SELECT generation FROM t UNION ALL SELECT generation FROM roots WHERE generation = 1 AND allocation_cursor <> 2)) SELECT generation FROM roots, z WHERE z IS NULL OR generation < z""",
    "root_faults": cte("roots", "root_inodes") + """, h AS (SELECT generation, max(inode) AS m, count(*) <> count(DISTINCT inode) AS w FROM root_inodes GROUP BY 1), b AS (SELECT * FROM roots LEFT JOIN h USING (generation))
SELECT generation, 'RESERVATION' AS fault FROM b WHERE reservation_end < 2 UNION ALL SELECT generation, 'CURSOR' FROM b WHERE allocation_cursor < 2 OR allocation_cursor > reservation_end
UNION ALL SELECT generation, 'INODE_BEYOND_CURSOR' FROM b WHERE m >= allocation_cursor UNION ALL SELECT generation, 'INODE_TWICE' FROM b WHERE w""",
    "name_faults": cte("namespace_names") + """, n AS (SELECT CASE WHEN target % 11 = 0 THEN 2 ELSE 1 END AS parent, target, CASE WHEN target % 41 = 0 THEN '..' WHEN target % 43 = 0 THEN 'a/b' WHEN target % 47 = 0 THEN repeat('n', 256) WHEN target % 53 = 0 THEN '' ELSE 'n' || target % 60 END AS name FROM namespace_names),
f AS (SELECT *, CASE WHEN name = '' OR length(name) > 255 OR name = '..' OR name LIKE '%/%' THEN 'NAME' WHEN parent <> 1 THEN 'PARENT' WHEN target <= 1 THEN 'TARGET' WHEN count(*) OVER (PARTITION BY parent, name) > 1 THEN 'TWICE' END AS fault FROM n)
SELECT fault, count(*) AS names, max(target) AS last FROM f WHERE fault IS NOT NULL GROUP BY fault""",
    "plan_is_current": "SELECT true AS current",
    "reorder_excess": cte("extents") + " SELECT file_id AS object_id, ordinal, abs(p - ordinal) AS moved FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY chunk_id, ordinal) - 1 AS p FROM extents) WHERE abs(p - ordinal) > 3",
    "phase_metrics": cte("phases") + " SELECT checkpoint, phase, count(*) AS runs, CAST(sum(wall_ms) AS BIGINT) AS wall_ms, CAST(sum(cpu_ms) AS BIGINT) AS cpu_ms, CAST(sum(bytes) AS BIGINT) AS bytes, max(wall_ms) AS worst_ms FROM phases GROUP BY ALL",
    "result_rows": cte("records") + """, r AS (SELECT CAST(chunks AS VARCHAR) AS policy, CAST(sum(raw_bytes) AS BIGINT) AS logical_bytes, CAST(sum(payload_bytes) AS BIGINT) AS payload_bytes, CAST(sum(line * 512) AS BIGINT) AS exact_hit_bytes FROM records GROUP BY chunks),
x AS (SELECT *, CASE WHEN logical_bytes > 0 THEN payload_bytes * 1000000 // logical_bytes ELSE 0 END AS ratio_ppm FROM r) SELECT *, concat_ws(',', policy, logical_bytes, payload_bytes, exact_hit_bytes, ratio_ppm) AS line FROM x""",
    "location_faults": f"""WITH {_C}, k AS (SELECT *, doc_id * 31 + i AS z FROM c)
SELECT doc_id AS container_id, i AS chunk_ordinal, CASE WHEN z % 101 = 0 THEN 'MISSING' WHEN z % 89 = 0 AND n <> 6 THEN 'LENGTH' ELSE 'ID' END AS fault FROM k
WHERE z % 101 = 0 OR (z % 89 = 0 AND p <> encode('spoilt')) OR (z % 89 <> 0 AND z % 97 = 0 AND p <> encode(repeat('x', CAST(n AS INTEGER))))""",
    "candidate_costs": cte("records") + """, r AS (SELECT record_id || ':' || line AS region, max(raw_bytes) AS r, max(payload_bytes) AS p, max(chunks) AS k FROM records GROUP BY 1),
t AS (SELECT region, 'RAW' AS e, r + 192 * k AS c FROM r UNION ALL SELECT region, 'ZSTD', p + 128 + 64 * k FROM r UNION ALL SELECT region, 'DICTIONARY', p - k * 100 + 900 FROM r),
b AS (SELECT region, min(struct_pack(c := c, e := e)) AS b, count(*) - 1 AS x, sum(c) AS z FROM t GROUP BY region)
SELECT b.e AS encoding, count(*) AS regions, CAST(sum(b.c) AS BIGINT) AS cost, CAST(sum(x) AS BIGINT) AS rejected, CAST(sum(z - b.c) AS BIGINT) AS rejected_bytes FROM b GROUP BY b.e""",
    "similarity_index_audit": cte("extents") + """, p AS (SELECT DISTINCT chunk_id, chunk_length AS n, CAST('0x' || chunk_id[1:2] AS INTEGER) % 9 <> 0 AS kept FROM extents)
SELECT s AS slot, 'MISSING' AS fault, count(*) AS postings FROM p, (SELECT unnest([0, 1]) AS s) WHERE NOT kept GROUP BY s UNION ALL SELECT 2, 'EXTRA', count(*) FROM p WHERE kept AND chunk_id[3:3] = 'a'""",
    "as_of_join": """WITH o AS (SELECT o_custkey AS k, o_orderkey * 3 % 5000 AS a, o_orderkey AS order_id FROM orders)
SELECT order_id, (SELECT max(event_id) FROM events WHERE user_id = o.k AND event_id <= o.a) AS event_id FROM o""",
    "approximate_distinct": "SELECT event_type, count(DISTINCT user_id) AS users, true AS close FROM events GROUP BY 1",
    "common_chunks": cte("required", "container_chunks") + " SELECT chunk_id FROM required WHERE generation % 2 = 0 INTERSECT SELECT chunk_id FROM container_chunks WHERE chunk_ordinal = 1",
    "unused_chunks": cte("required", "container_chunks") + " SELECT chunk_id, count(*) AS n FROM (SELECT chunk_id, logical_length FROM container_chunks EXCEPT ALL SELECT chunk_id, logical_length FROM required WHERE generation % 5 <> 0) GROUP BY 1",
}
