"""Reports: plain partial and final aggregation, integer rates, percentiles, decision rules of encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Savings that an encoding must reach, sizes of a record's header, chunk entries and alignment.
MIN_SAVING, ZSTD_PERCENT, DELTA_PERCENT = 4096, 3, 5
RECORD_HEADER, RECORD_CHUNK, RECORD_ALIGN = 128, 64, 64


def hit_rate(accesses: DataFrame, *by: str) -> DataFrame:
    """Accesses, hits and the hit rate in basis points, rounded down; 0 without accesses."""
    sums = accesses.groupBy(*by).agg(F.count("*").alias("accesses"), F.count_if("hit").alias("hits"))
    return sums.withColumn("basis_points", F.expr("CASE WHEN accesses = 0 THEN 0 ELSE hits * 10000 DIV accesses END"))


def latency(accesses: DataFrame, *by: str) -> DataFrame:
    """Exact percentiles of latency_ms by nearest value below."""
    return accesses.groupBy(*by).agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY latency_ms)").cast("long").alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))], F.max("latency_ms").alias("worst"))


def rollup(chunks: DataFrame, outer: str, inner: str) -> DataFrame:
    """Chunks and bytes by (outer, inner), by outer and in all, with the level of grouping."""
    return chunks.rollup(outer, inner).agg(F.grouping_id().alias("level"), F.count("*").alias("chunks"), F.sum("length").alias("bytes"))


def zstd_accepts(raw, payload):
    """Whether a compressed payload replaces the raw one."""
    saved = raw - payload
    return (payload < raw) & (saved >= MIN_SAVING) & (saved * 100 >= raw * ZSTD_PERCENT)


def delta_accepts(independent, cost):
    """Whether a delta replaces the independent payload."""
    saved = independent - cost
    return (saved >= MIN_SAVING) & (saved * 100 >= independent * DELTA_PERCENT)


def record_bytes(payload, chunks):
    """Size of a record with its header and chunk table, aligned."""
    whole = payload + RECORD_HEADER + RECORD_CHUNK * chunks
    return F.ceil(whole / RECORD_ALIGN).cast("long") * RECORD_ALIGN


def raw_record_bytes(length):
    """Size of the raw record of one chunk."""
    return record_bytes(length, F.lit(1))


def raw_records(lengths):
    """Size of the raw records of an array of chunk lengths, a record for each."""
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda n, x: n + raw_record_bytes(x))


def payload_cap(raw, chunks):
    """Largest payload with which a compressed record of so many chunks still wins over their raw records (``raw``, all bytes): less the
    saving, aligned, less header and table."""
    percent = F.ceil(raw * ZSTD_PERCENT / 100).cast("long")
    room = F.greatest(F.lit(0).cast("long"), raw - F.greatest(F.lit(MIN_SAVING).cast("long"), percent))
    return F.greatest(F.lit(0).cast("long"), room - room % RECORD_ALIGN - RECORD_HEADER - RECORD_CHUNK * chunks)


def record_win(raw, payload, chunks):
    """Whether a compressed record, whole and aligned, replaces the raw records."""
    return payload <= payload_cap(raw, chunks)


def checkpoint_trigger(states: DataFrame) -> DataFrame:
    """Adds action: what the rules of age and volume ask for, the first that holds."""
    c = F.col
    wait = F.least(2000 - c("dirty_age_ms"), F.coalesce(500 - c("container_age_ms"), F.lit(2000)))
    return states.withColumn(
        "action",
        F.when(c("dirty_age_ms") >= 5000, "PAUSE_AND_COMMIT").when(c("sealed") >= 8, "COMMIT").when(c("dirty_age_ms") >= 2000, "COMMIT").when(c("container_age_ms") >= 500, "COMMIT").otherwise("WAIT"),
    ).withColumn("wait_ms", F.when(c("action") == "WAIT", F.greatest(F.lit(0), wait)))


def handle_fence(events: DataFrame) -> DataFrame:
    """(handle, accepted, applied, refused, close_ready) from events (handle, seq, op, sequence) in the order of seq.

    An acceptance takes the next sequence; a completion counts only for the sequence after the last one applied, and only if that has been
    accepted. A handle may close when all accepted operations are applied. The fold is over one handle's events.
    """
    none = F.struct(F.lit(0).cast("long").alias("accepted"), F.lit(0).cast("long").alias("applied"), F.lit(0).cast("long").alias("refused"))

    def step(state, e):
        accept = (e.op == "accept").cast("long")
        good = ((e.op == "complete") & (e["sequence"] == state.applied + 1) & (e["sequence"] <= state.accepted)).cast("long")
        return F.struct((state.accepted + accept).alias("accepted"), (state.applied + good).alias("applied"), (state.refused + 1 - accept - good).alias("refused"))

    lists = events.groupBy("handle").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "sequence"))).alias("e"))
    return lists.select("handle", F.aggregate("e", none, step).alias("s")).select("handle", "s.*", (F.col("s.accepted") == F.col("s.applied")).alias("close_ready"))


def phase_metrics(phases: DataFrame, *by: str) -> DataFrame:
    """Additive wall and CPU time and bytes of checkpoint phases (phase, wall_ms, cpu_ms, bytes)."""
    return phases.groupBy(*by, "phase").agg(F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in ("wall_ms", "cpu_ms", "bytes")], F.max("wall_ms").alias("worst_ms"))


def result_rows(runs: DataFrame) -> DataFrame:
    """Rows (policy, logical_bytes, payload_bytes, exact_hit_bytes, ratio_ppm, line) of policy runs; ``line`` is the CSV row."""
    ratio = F.when(F.col("logical_bytes") > 0, F.expr("payload_bytes * 1000000 DIV logical_bytes")).otherwise(0)
    rows = runs.withColumn("ratio_ppm", ratio.cast("long"))
    return rows.withColumn("line", F.concat_ws(",", "policy", "logical_bytes", "payload_bytes", "exact_hit_bytes", "ratio_ppm"))


def reorder_excess(regions: DataFrame, most: int) -> DataFrame:
    """Regions (object_id, ordinal, place) that a reordering moved further than ``most`` places; must be empty."""
    moved = F.abs(F.col("place") - F.col("ordinal"))
    return regions.withColumn("moved", moved).where(moved > most)


def directory_page(names: DataFrame, cookie: int, size: int) -> DataFrame:
    """Names of each directory in byte order after ``cookie`` entries, ``size`` at most; '.' and '..' are the first two."""
    dots = names.select("parent").distinct().select("parent", F.explode(F.array(F.lit("."), F.lit(".."))).alias("name"))
    both = dots.withColumn("first", F.lit(0)).unionByName(names.select("parent", "name", F.lit(1).alias("first")))
    place = F.row_number().over(Window.partitionBy("parent").orderBy("first", "name"))
    return both.withColumn("cookie", place.cast("long")).where((F.col("cookie") > cookie) & (F.col("cookie") <= cookie + size)).select("parent", "name", "cookie")


def reorder_rank(regions: DataFrame) -> DataFrame:
    """Adds place and reordered: regions sorted by (window, features, ordinal) within an object."""
    by = Window.partitionBy("object_id").orderBy("window", "features", "ordinal")
    ranked = regions.withColumn("place", (F.row_number().over(by) - 1).cast("long"))
    return ranked.withColumn("reordered", F.col("place") != F.col("ordinal"))
