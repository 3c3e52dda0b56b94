"""Liveness of containers and the plan of a garbage collection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["chunk_id", "logical_length"]
# Bounds of the estimates in bytes and chunks.
TARGET_BYTES = 48 * 1024 * 1024 - 256 * 1024
MAX_CHUNKS = 32_768
CHUNK_OVERHEAD, CONTAINER_OVERHEAD = 383, 12_351


def classify(container_chunks: DataFrame, online: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(container_id, chunks, live_chunks, bytes, state): RECLAIMABLE without live chunks, RETAINED with live ones only, else PARTIAL.

    bytes is the length of the container's file, from ``files`` (container_id, file_bytes); without it the chunks' logical bytes.
    """
    live = container_chunks.join(online.select(*KEY).withColumn("live", F.lit(1)), KEY, "left")
    sums = live.groupBy("container_id").agg(F.count("*").alias("chunks"), F.coalesce(F.sum("live"), F.lit(0)).alias("live_chunks"), F.sum("logical_length").alias("bytes"))
    state = F.when(F.col("live_chunks") == 0, "RECLAIMABLE").when(F.col("live_chunks") < F.col("chunks"), "PARTIAL").otherwise("RETAINED")
    sums = sums.withColumn("state", state)
    if files is None:
        return sums
    return sums.drop("bytes").join(files.select("container_id", F.col("file_bytes").alias("bytes")), "container_id").select("container_id", "chunks", "live_chunks", "bytes", "state")


def replacement_set(container_chunks: DataFrame, online: DataFrame, states: DataFrame) -> DataFrame:
    """Live chunks that only partial containers hold."""
    live = container_chunks.join(online, KEY, "left_semi").join(states.select("container_id", "state"), "container_id")
    return live.groupBy(*KEY).agg(F.bool_or(F.col("state") == "RETAINED").alias("retained")).where("NOT retained").select(*KEY)


def gc_plan(states: DataFrame, replacement: DataFrame) -> DataFrame:
    """One row: counts, the estimate of new containers, whether partial containers are collected, and bytes that come back."""
    r = replacement.agg(F.count("*").alias("replaced_chunks"), F.coalesce(F.sum("logical_length"), F.lit(0)).alias("replaced_bytes"))
    s = states.agg(
        F.count_if(F.col("state") == "RECLAIMABLE").alias("reclaimable"),
        F.count_if(F.col("state") == "PARTIAL").alias("partial"),
        F.coalesce(F.sum(F.when(F.col("state") == "RECLAIMABLE", F.col("bytes"))), F.lit(0)).alias("reclaimable_bytes"),
        F.coalesce(F.sum(F.when(F.col("state") == "PARTIAL", F.col("bytes"))), F.lit(0)).alias("partial_bytes"),
    )
    both = s.join(F.broadcast(r))  # one row each
    new = F.expr(f"replaced_bytes DIV {TARGET_BYTES} + replaced_chunks DIV {MAX_CHUNKS} + 1")
    both = both.withColumn("new_containers", F.when(F.col("replaced_chunks") == 0, 0).otherwise(new).cast("long"))
    both = both.withColumn("collect_partial", (F.col("replaced_chunks") == 0) | ((F.col("partial") >= 2) & (F.col("new_containers") < F.col("partial"))))
    bound = F.col("replaced_bytes") + CHUNK_OVERHEAD * F.col("replaced_chunks") + CONTAINER_OVERHEAD * F.col("new_containers")
    both = both.withColumn("replacement_bound", bound.cast("long"))
    gain = F.when(F.col("collect_partial"), F.greatest(F.lit(0), F.col("partial_bytes") - F.col("replacement_bound"))).otherwise(0)
    return both.withColumn("estimated_bytes", (F.col("reclaimable_bytes") + gain).cast("long"))


def priorities(pools: DataFrame) -> DataFrame:
    """Adds scrub and gc priorities: NORMAL from 90 % use; the collection also beyond 20 % of reclaimable bytes."""
    full = F.col("used") * 10 >= F.col("capacity") * 9
    much = (F.col("container_bytes") != 0) & (F.col("reclaimable") * 5 > F.col("container_bytes"))
    return pools.withColumn("scrub", F.when(full, "NORMAL").otherwise("BACKGROUND")).withColumn("gc", F.when(full | much, "NORMAL").otherwise("BACKGROUND"))


def replacement_order(container_chunks: DataFrame, replacement: DataFrame, victims: DataFrame) -> DataFrame:
    """(container_id, chunk_ordinal, chunk_id, logical_length): the first copy of each needed chunk among the victims."""
    copies = container_chunks.join(victims.select("container_id"), "container_id", "left_semi").join(replacement, KEY, "left_semi")
    first = copies.groupBy(*KEY).agg(F.min(F.struct("container_id", "chunk_ordinal")).alias("f"))
    return first.select("f.container_id", "f.chunk_ordinal", *KEY)


def victims(states: DataFrame, plan: DataFrame) -> DataFrame:
    """(container_id): what a plan deletes: reclaimable containers, and partial ones if it collects them."""
    return states.join(F.broadcast(plan.select("collect_partial"))).where("state = 'RECLAIMABLE' OR (state = 'PARTIAL' AND collect_partial)").select("container_id")  # one row


def replacement_batches(copies: DataFrame, target: int = TARGET_BYTES, chunks: int = MAX_CHUNKS) -> DataFrame:
    """Adds batch and place to the copies of ``replacement_order``, in the order of containers: a batch closes before it would exceed ``target`` bytes or
    ``chunks`` chunks.

    The rule is sequential, but it needs lengths only: containers are sorted side by side and their lengths, eight bytes a row, go through one
    task, which finds the batch, place and bytes that each container begins with. From there containers are packed side by side again.
    """
    names = ["container_id", "chunk_ordinal", *KEY]
    rows = copies.select(*names).repartition("container_id").sortWithinPartitions(*names)
    kind = rows.schema["container_id"].dataType.simpleString()

    def step(lengths, batch_no, place, size):
        """(batch, place) of each length, and the state behind them."""
        at, places = [], []
        for n in lengths:
            if place and (size + n > target or place >= chunks):
                batch_no, place, size = batch_no + 1, 0, 0
            at.append(batch_no)
            places.append(place)
            place, size = place + 1, size + n
        return at, places, (batch_no, place, size)

    def lengths(batches):
        part = 0
        for batch in batches:
            # Runs of one container; a container's later parts have higher numbers.
            ids, sizes = batch.column(0), batch.column(3).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), len(ids)] if len(ids) else []
            spans = list(zip(edges, edges[1:]))
            packed = [sizes[x:y].astype("<i8").tobytes() for x, y in spans]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([x for x, _ in spans], pa.int64())), pa.array(range(part, part + len(spans)), pa.int64()), pa.array(packed, pa.binary())], names=["container_id", "part", "lengths"])
            part += len(spans)

    def states(batches):
        state, last = (0, 0, 0), None
        for batch in batches:
            out = []
            for c, packed in zip(batch.column(0).to_pylist(), batch.column(2)):
                if c != last or last is None:
                    out.append((c, *state))
                last, state = c, step(np.frombuffer(packed.as_py(), "<i8").tolist(), *state)[2]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.types[0]), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["container_id", "_batch", "_place", "_size"])

    def run(batches):
        state, last = None, None
        for batch in batches:
            ids, sizes = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            begins = list(zip(*(batch.column(k).to_pylist() for k in (4, 5, 6))))
            at, places, k = [], [], 0
            while k < len(ids):
                if state is None or ids[k] != last:
                    last, state = ids[k], begins[k]
                end = k
                while end < len(ids) and ids[end] == last:
                    end += 1
                a, p, state = step(sizes[k:end], *state)
                at, places, k = at + a, places + p, end
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(at, pa.int64()), pa.array(places, pa.int64())], names=[*names, "batch", "place"])

    narrow = rows.mapInArrow(lengths, f"container_id {kind}, part long, lengths binary")
    begin = narrow.repartition(1).sortWithinPartitions("container_id", "part").mapInArrow(states, f"container_id {kind}, _batch long, _place long, _size long")
    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields), "batch long, place long"])
    dealt = copies.select(*names).repartition("container_id").join(begin, "container_id")
    return dealt.select(*names, "_batch", "_place", "_size").repartition("container_id").sortWithinPartitions(*names).mapInArrow(run, schema)


def collect_garbage(container_chunks: DataFrame, online: DataFrame, files: DataFrame, domain: str, generation: int) -> DataFrame:
    """(container_id, chunk_ordinal, chunk_id, logical_length, origin): the containers after a collection. KEPT rows stay where they are; NEW rows are the needed
    chunks of collected containers in containers with ids of their own; all other rows are gone."""
    states = classify(container_chunks, online, files)
    replaced = replacement_set(container_chunks, online, states)
    plan = gc_plan(states, replaced)
    gone = victims(states, plan)
    kept = container_chunks.join(gone, "container_id", "left_anti").select("container_id", "chunk_ordinal", *KEY, F.lit("KEPT").alias("origin"))
    partial = states.where("state = 'PARTIAL'").join(gone, "container_id", "left_semi").select("container_id")
    packed = replacement_batches(replacement_order(container_chunks, replaced, partial))
    ids = replacement_id(packed, domain, generation)
    new = packed.drop("container_id").join(ids, "batch").select("container_id", F.col("place").alias("chunk_ordinal"), *KEY, F.lit("NEW").alias("origin"))
    return kept.unionByName(new)


def collection_faults(before: DataFrame, after: DataFrame, online: DataFrame) -> DataFrame:
    """Online chunks that had a container before a collection and have none after it; must be empty, else nothing may be deleted."""
    return online.join(before.select(*KEY), KEY, "left_semi").join(after.select(*KEY), KEY, "left_anti")


def replacement_id(packed: DataFrame, domain: str, generation: int) -> DataFrame:
    """(batch, container_id): a deterministic id from the batch's chunk ids and lengths in order."""
    part = F.concat_ws(":", "chunk_id", "logical_length")
    lists = packed.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("place", part.alias("p")))).alias("c"))
    return lists.select("batch", F.left(F.sha2(F.concat_ws("|", F.lit(domain), F.lit(generation), F.array_join(F.transform("c", lambda x: x.p), ",")), 256), F.lit(32)).alias("container_id"))


def scrub_report(container_chunks: DataFrame, required: DataFrame, entries: DataFrame) -> DataFrame:
    """One row of counts over containers, generations and the index."""
    a = container_chunks.agg(F.countDistinct("container_id").alias("containers"), F.count("*").alias("chunks"), F.sum("logical_length").alias("bytes"))
    b = required.agg(F.countDistinct("generation").alias("generations"), F.max("generation").alias("newest_generation"))
    c = entries.agg(F.count_if(F.col("transition") == "ACTIVE").alias("active_entries"), F.max("generation").alias("high_water"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))  # one row each
