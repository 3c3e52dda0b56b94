"""Files as a log of mutations: names and attributes from the last operations, contents from the overlay of writes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.intervals import overlay


def namespace(ops: DataFrame) -> DataFrame:
    """(parent, name, inode): names after the operations (seq, op, parent, name, inode[, new_parent, new_name]).

    CREATE and LINK set a name, UNLINK clears it, RENAME clears the old and sets the new one. The last operation on a name decides.
    """
    named = ops.where("op IN ('CREATE', 'LINK')").select("parent", "name", "seq", "inode")
    gone = ops.where("op IN ('UNLINK', 'RENAME')").select("parent", "name", "seq", F.lit(None).cast("long").alias("inode"))
    moved = ops.where("op = 'RENAME'").select(F.col("new_parent").alias("parent"), F.col("new_name").alias("name"), "seq", "inode")
    last = named.unionByName(gone).unionByName(moved).groupBy("parent", "name").agg(F.max(F.struct("seq", "inode")).alias("l"))
    return last.select("parent", "name", F.col("l.inode").alias("inode")).where("inode IS NOT NULL")


def attributes(ops: DataFrame) -> DataFrame:
    """(inode, logical_size, mutation_sequence) after WRITE (offset, length), APPEND (length) and SET_LENGTH (length) operations.

    The size after an operation depends on that before it, so each inode's operations fold in sequence; the fold is an aggregate over the sorted
    list of an inode's size changes since its last SET_LENGTH, the only ones that matter.
    """
    sized = ops.where("op IN ('WRITE', 'APPEND', 'SET_LENGTH') AND (length > 0 OR op = 'SET_LENGTH')")
    by = Window.partitionBy("inode")
    last_set = F.max(F.when(F.col("op") == "SET_LENGTH", F.col("seq"))).over(by)
    tail = sized.withColumn("last_set", last_set).where("last_set IS NULL OR seq >= last_set")
    steps = tail.groupBy("inode").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "offset", "length"))).alias("s"), F.max("seq").alias("mutation_sequence"))
    size = F.aggregate(
        "s",
        F.lit(0).cast("long"),
        lambda n, x: F.when(x.op == "SET_LENGTH", x.length).when(x.op == "APPEND", n + x.length).otherwise(F.greatest(n, x.offset + x.length)),
    )
    return steps.select("inode", size.alias("logical_size"), "mutation_sequence")


def contents(writes: DataFrame, lengths: DataFrame | None = None, base: DataFrame | None = None) -> DataFrame:
    """(file_id, range_start, range_end, bytes): what is seen of writes (file_id, seq, range_start, bytes) when the last writer wins; the rest reads as zeros.

    ``lengths`` (file_id, seq, length) are SET_LENGTH operations: what stood beyond the new length is gone, also after the file has grown again.
    ``base`` (file_id, range_start, bytes) is the committed content, older than all of these.
    """
    if base is not None:
        writes = writes.select("file_id", "seq", "range_start", "bytes").unionByName(base.select("file_id", F.lit(-1).cast("long").alias("seq"), "range_start", "bytes"))
    ranges = writes.select("file_id", "seq", "range_start", (F.col("range_start") + F.octet_length("bytes")).alias("range_end"))
    if lengths is not None:
        ends = ranges.groupBy("file_id").agg(F.max("range_end").alias("range_end"))
        gone = lengths.join(ends, "file_id").select("file_id", "seq", F.col("length").alias("range_start"), "range_end")
        ranges = ranges.unionByName(gone)
    seen = overlay(ranges.where("range_end > range_start")).withColumnRenamed("range_start", "a")
    joined = seen.join(writes.select("file_id", "seq", "range_start", "bytes"), ["file_id", "seq"])  # pieces of a SET_LENGTH have no bytes
    part = F.substring(F.col("bytes"), (F.col("a") - F.col("range_start") + 1).cast("int"), (F.col("range_end") - F.col("a")).cast("int"))
    return joined.select("file_id", F.col("a").alias("range_start"), "range_end", part.alias("bytes"))


def results(ops: DataFrame) -> DataFrame:
    """(seq, op, result) of name operations (seq, op, parent, name, inode[, new_parent, new_name, no_replace]) in the order of seq.

    LOOKUP, UNLINK and RENAME of a name that is not there give NO_ENTRY; CREATE of one that is, and RENAME onto one with ``no_replace``, give
    EXISTS; all else OK. Whether a name is there follows from the last operation before that set or cleared it; failed ones set and clear nothing, so names
    are folded in the order of seq, one directory in hand at a time (renames between directories take part in both).
    """
    wide = ops.select("seq", "op", "parent", "name", "new_parent", "new_name", F.coalesce("no_replace", F.lit(False)).alias("no_replace"))
    lists = wide.groupBy().agg(F.array_sort(F.collect_list(F.struct(*wide.columns))).alias("o")) if _crosses(wide) else wide.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct(*wide.columns))).alias("o"))

    def fold(batches):
        for batch in batches:
            out = []
            for steps in batch.column(0).to_pylist():
                there: set[tuple] = set()
                for x in steps:
                    name, to = (x["parent"], x["name"]), (x["new_parent"], x["new_name"])
                    result = "OK"
                    if x["op"] in ("LOOKUP", "UNLINK", "RENAME") and name not in there:
                        result = "NO_ENTRY"
                    elif x["op"] in ("CREATE", "LINK") and name in there or x["op"] == "RENAME" and x["no_replace"] and to in there:
                        result = "EXISTS"
                    elif x["op"] in ("CREATE", "LINK"):
                        there.add(name)
                    elif x["op"] == "UNLINK":
                        there.discard(name)
                    elif x["op"] == "RENAME":
                        there.discard(name)
                        there.add(to)
                    out.append((x["seq"], x["op"], result))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))], names=["seq", "op", "result"])

    return lists.select("o").mapInArrow(fold, "seq long, op string, result string")


def _crosses(ops: DataFrame) -> bool:
    """Whether a rename leads out of its directory."""
    return not ops.where("op = 'RENAME' AND NOT (new_parent <=> parent)").isEmpty()


def orphans(ops: DataFrame) -> DataFrame:
    """(inode): inodes without a name that a handle still holds (OPEN and RELEASE operations); they go with their last handle."""
    held = ops.groupBy("inode").agg(F.count_if(F.col("op") == "OPEN").alias("opened"), F.count_if(F.col("op") == "RELEASE").alias("released")).where("opened > released").select("inode")
    return held.join(namespace(ops).select("inode"), "inode", "left_anti")
