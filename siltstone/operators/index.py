"""A chunk index as a change log in sorted runs: newest wins, lookups, compaction and audits."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Physical place of a chunk.
LOCATION = ["chunk_id", "logical_length", "container_id", "record_offset", "chunk_ordinal"]
#: Lookups return at most so many entries and try so many active ones.
LOOKUP_LIMIT, ACTIVE_TRIES = 64, 2
#: Families that a compaction takes, and entries after which a partition of a run closes.
FAN_IN, PARTITION_ENTRIES = 4, 262_144


def newest_wins(entries: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The newest entry of each location; removals stay as tombstones.

    A grouped maximum over (generation, row), combined before the shuffle; equal generations are settled by the entry's other columns.
    """
    key = key or LOCATION
    rest = [c for c in entries.columns if c not in key and c != "generation"]
    best = entries.groupBy(*key).agg(F.max(F.struct("generation", *sorted(rest))).alias("b"))
    return best.select(*key, *[F.col(f"b.{c}").alias(c) for c in ["generation", *rest]])


def run_sorted(entries: DataFrame, partitions: int) -> DataFrame:
    """Entries in the order of a run: ranges of chunk ids by partition, sorted within. No chunk id is in two partitions. There are ``partitions`` of them, and
    more where they would hold over PARTITION_ENTRIES on average."""
    partitions = max(partitions, -(-entries.count() // PARTITION_ENTRIES))
    return entries.repartitionByRange(partitions, "chunk_id").sortWithinPartitions(*LOCATION)


def duplicate_locations(entries: DataFrame) -> DataFrame:
    """Locations that a run holds twice in one generation."""
    return entries.groupBy(*LOCATION, "generation").agg(F.count("*").alias("n")).where("n > 1")


def lookup(entries: DataFrame, limit: int = LOOKUP_LIMIT) -> DataFrame:
    """Entries of each chunk, newest generation first, then highest level, up to the limit; ``complete`` tells whether all are surely there,
    which a full list never is.

    The rank stands alone over its window, so Spark keeps the first rows of a hot chunk before the shuffle; sizes are a grouped count.
    """
    order = [F.col("generation").desc(), F.col("level").desc(), "container_id", "record_offset", "chunk_ordinal", "transition"]
    key = ["chunk_id", "logical_length"]
    ranked = entries.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= limit)
    sizes = entries.groupBy(*key).agg((F.count("*") < limit).alias("complete"))
    return ranked.join(sizes, key)


def resolve(entries: DataFrame, tries: int = ACTIVE_TRIES, limit: int = LOOKUP_LIMIT) -> DataFrame:
    """(chunk_id, logical_length, candidates): active locations to try, in order, after the newest transition of each place among the
    entries that a lookup gives has won."""
    now = newest_wins(lookup(entries, limit).drop("rank", "complete")).where("transition = 'ACTIVE'")
    order = [F.col("generation").desc(), "container_id", "record_offset", "chunk_ordinal"]
    ranked = now.withColumn("rank", F.row_number().over(Window.partitionBy("chunk_id", "logical_length").orderBy(*order))).where(F.col("rank") <= tries)
    place = F.concat_ws(":", "container_id", "record_offset", "chunk_ordinal")
    return ranked.groupBy("chunk_id", "logical_length").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", place.alias("p")))), lambda x: x.p), ",").alias("candidates"))


def lookup_with_fallback(keys: DataFrame, index: DataFrame, scanned: DataFrame) -> DataFrame:
    """The index's location, else that of a full scan; (chunk_id, location, source)."""
    joined = keys.join(index.select("chunk_id", F.col("location").alias("i")), "chunk_id", "left").join(scanned.select("chunk_id", F.col("location").alias("s")), "chunk_id", "left")
    return joined.select("chunk_id", F.coalesce("i", "s").alias("location"), F.when(F.col("i").isNotNull(), "index").when(F.col("s").isNotNull(), "scan").alias("source"))


def families(entries: DataFrame) -> DataFrame:
    """(level, family, entries, low, high): key range and size of each family of runs."""
    return entries.groupBy("level", "family").agg(F.count("*").alias("entries"), F.min("chunk_id").alias("low"), F.max("chunk_id").alias("high"))


def compaction_selection(found: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The oldest families of the lowest level that has enough of them."""
    sized = found.withColumn("n", F.count("*").over(Window.partitionBy("level"))).where(F.col("n") >= fan_in)
    lowest = sized.agg(F.min("level").alias("level"))
    oldest = F.row_number().over(Window.partitionBy("level").orderBy("family"))
    return sized.join(F.broadcast(lowest), "level").withColumn("rank", oldest).where(F.col("rank") <= fan_in).select("level", "family", "rank")  # one row


def compaction_faults(chosen: DataFrame, generation: int) -> DataFrame:
    """(fault) of the inputs (level, family) of a compaction; must be empty: 2 to 64 distinct families, all older than the target."""
    sums = chosen.agg(F.count("*").alias("n"), F.countDistinct("family").alias("d"), F.max("family").alias("newest"))
    faults = F.array_compact(F.array(F.when(~F.col("n").between(2, 64), "COUNT"), F.when(F.col("n") != F.col("d"), "REPEATED"), F.when(F.col("newest") >= generation, "TARGET_NOT_NEWER")))
    return sums.select(F.explode(faults).alias("fault"))


def compact(entries: DataFrame, chosen: DataFrame, generation: int) -> DataFrame:
    """Entries after the chosen families have become one at the next level. Inputs that ``compaction_faults`` names are refused."""
    faults = [r.fault for r in compaction_faults(chosen, generation).collect()]  # three at most
    if faults:
        raise ValueError(f"these families cannot be compacted: {', '.join(faults)}")
    chosen = chosen.select("level", "family")
    merged = newest_wins(entries.join(chosen, ["level", "family"], "left_semi"))
    merged = merged.withColumn("level", F.col("level") + 1).withColumn("family", F.lit(generation))
    return entries.join(chosen, ["level", "family"], "left_anti").unionByName(merged.select(*entries.columns))


def partition_cuts(entries: DataFrame, target: int = PARTITION_ENTRIES) -> DataFrame:
    """(family, partition, entries, low, high): a family's entries in the order of chunk ids, cut where a partition holds ``target`` entries or
    more, never inside a chunk id.

    A partition's end depends on where it began, so the cuts follow one another; they run over counts of chunk ids (not over entries) in
    sorted order, one family in a task, with a carried state of two numbers.
    """
    counts = entries.groupBy("family", "chunk_id").agg(F.count("*").alias("n"))

    def run(batches):
        family, part, n, low, high, out = None, 0, 0, None, None, []
        for batch in batches:
            for f, chunk, m in zip(*(c.to_pylist() for c in batch.columns)):
                if n and (f != family or n >= target):
                    out.append((family, part, n, low, high))
                    part, n = (part + 1 if f == family else 0), 0
                family, low, high, n = f, chunk if not n else low, chunk, n + m
            yield _cut_rows(out)
            out = []
        if n:
            yield _cut_rows([(family, part, n, low, high)])

    kind = {x.name: x.dataType.simpleString() for x in counts.schema.fields}
    dealt = counts.repartition("family").sortWithinPartitions("family", "chunk_id")
    return dealt.mapInArrow(run, f"family {kind['family']}, partition long, entries long, low {kind['chunk_id']}, high {kind['chunk_id']}")


def _cut_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["family", "partition", "entries", "low", "high"])


def cascade(found: list[tuple[int, int]], generation: int, fan_in: int = FAN_IN) -> dict[tuple[int, int], tuple[int, int]]:
    """Where each family (level, family) ends up when compactions run as long as a level has ``fan_in`` families; new families count up from ``generation``."""
    now, ends = set(found), {f: f for f in found}
    while levels := [n for n in {level for level, _ in now} if sum(level == n for level, _ in now) >= fan_in]:
        level, generation = min(levels), generation + 1
        taken = sorted(f for f in now if f[0] == level)[:fan_in]
        now = (now - set(taken)) | {(level + 1, generation)}
        ends = {f: (level + 1, generation) if e in taken else e for f, e in ends.items()}
    return ends


def publish(entries: DataFrame, new: DataFrame, generation: int, fan_in: int = FAN_IN) -> DataFrame:
    """The index after a new run of level 0 and the compactions that it sets off.

    Which families merge follows from the list of families alone, and newest-wins merges compose, so the whole cascade is one
    merge: each family's entries go straight to the family that they end up in. Families, a few for each level, reach the driver.
    """
    run = new.withColumn("level", F.lit(0).cast("long")).withColumn("family", F.lit(generation).cast("long"))
    now = entries.unionByName(run.select(*entries.columns))
    ends = cascade([(r.level, r.family) for r in now.select("level", "family").distinct().collect()], generation, fan_in)
    moves = entries.sparkSession.createDataFrame([(*f, *e) for f, e in ends.items() if f != e], "level long, family long, to_level long, to_family long")
    stay = now.join(F.broadcast(moves), ["level", "family"], "left_anti")
    moved = now.join(F.broadcast(moves), ["level", "family"]).drop("level", "family").withColumnsRenamed({"to_level": "level", "to_family": "family"})
    merged = newest_wins(moved, [*LOCATION, "level", "family"])
    return stay.select(*entries.columns).unionByName(merged.select(*entries.columns))


def overlapping_partitions(partitions: DataFrame) -> DataFrame:
    """Partitions (family, low, high) of a family whose key ranges overlap."""
    by = Window.partitionBy("family").orderBy("low", "high")
    return partitions.withColumn("before", F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1))).where("low <= before").select("family", "low", "high")


def orphans(entries: DataFrame, container_chunks: DataFrame) -> DataFrame:
    """Active entries whose container does not hold the chunk; must be empty."""
    active = newest_wins(entries).where("transition = 'ACTIVE'").select("container_id", "chunk_id", "logical_length").distinct()
    return active.join(container_chunks, ["container_id", "chunk_id", "logical_length"], "left_anti")


def rebuild(container_chunks: DataFrame, generation: int) -> DataFrame:
    """Index entries from a scan of all containers."""
    return container_chunks.select("chunk_id", "logical_length", "container_id", "record_offset", "chunk_ordinal", F.lit(generation).cast("long").alias("generation"), F.lit(0).cast("long").alias("level"), F.lit("ACTIVE").alias("transition"))
