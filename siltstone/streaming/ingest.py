"""Streams of file writes: contiguous lanes with a carried tail, stable chunks, idempotent commits of micro-batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.functions.cdc import CdcProfile, cuts

STATE = "tail binary, base long, next_offset long, last_seq long"
CHUNKS = "inode long, input_offset long, length long, chunk_id string, first_seq long"


def stable_chunks(tail: bytes, profile: CdcProfile, final: bool = False) -> list[int]:
    """Ends of the chunks of a tail that later bytes cannot change: those that end at least a longest chunk before the tail's end."""
    found = cuts(tail, profile)
    return found if final else [c for c in found if c <= len(tail) - profile.most]


def lane_chunks(writes: DataFrame, profile: CdcProfile = CdcProfile()) -> DataFrame:
    """A stream of chunks (inode, input_offset, length, chunk_id, first_seq) from a stream of writes (inode, seq, offset, data, closed).

    Each inode is a lane: writes that follow on are appended to the tail; a gap or a sequence that does not grow drops the tail and starts anew there. A
    write with ``closed`` gives the rest of the lane. State is the tail, shorter than two of the longest chunks and one batch.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, base, ahead, last = state.get if state.exists else (b"", 0, 0, -1)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []

        def emit(final: bool):
            nonlocal tail, base
            begin = 0
            for end in stable_chunks(tail, profile, final):
                part = tail[begin:end]
                out.append((key[0], base + begin, end - begin, hashlib.sha256(part).hexdigest(), last))
                begin = end
            tail, base = tail[begin:], base + begin

        for row in rows.itertuples(index=False):
            if row.offset != ahead or row.seq <= last:
                tail, base = b"", row.offset
            tail, ahead, last = tail + bytes(row.data), row.offset + len(row.data), row.seq
            if len(tail) > 2 * profile.most:
                emit(False)
            if row.closed:
                emit(True)
        emit(False)
        state.update((tail, base, ahead, last))
        yield pd.DataFrame(out, columns=["inode", "input_offset", "length", "chunk_id", "first_seq"])

    return writes.groupBy("inode").applyInPandasWithState(fold, CHUNKS, STATE, "append", GroupStateTimeout.NoTimeout)


def commit_batches(chunks: DataFrame, target: str, checkpoint: str, trigger: dict | None = None):
    """Starts a query that adds each micro-batch's new chunks to ``target``: chunks that are there, or twice in the batch, are left out.

    A batch writes a folder of its own number, so a batch that runs again replaces its first try and adds nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["chunk_id", "length"])
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            there = spark.read.option("recursiveFileLookup", "true").schema(CHUNKS + ", batch long").parquet(target).where(F.col("batch") < number)
            fresh = fresh.join(there.select("chunk_id", "length"), ["chunk_id", "length"], "left_anti")
        fresh.select(*[x.split()[0] for x in CHUNKS.split(", ")], F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{target}/part-{number:09d}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_activity(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """(start, event_type, events, value): counts by tumbling window of event time; later rows than the watermark are dropped. Works on streams and tables."""
    marked = events.withWatermark("ts", lateness) if events.isStreaming else events
    sums = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return sums.select(F.col("w.start").alias("start"), "event_type", "events", "value")
