"""Byte-range algebra over extents and ranges.

Extents are rows (file_id, ordinal, logical_offset, length, kind, ...), half-open ranges are (file_id, range_start, range_end). Everything is keyed
by file, so joins are equi joins on the file with an overlap condition, and windows are partitioned by file.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Leaves of a recipe tree hold so many extents and lie in one window of so many bytes.
LEAF_EXTENTS, LEAF_WINDOW = 1024, 64 << 20
#: Bytes of one read.
MAX_READ = 1 << 20


def _end():
    return F.col("logical_offset") + F.col("length")


_RECIPE = ["file_id", "logical_offset", "length", "kind", "chunk_id", "chunk_offset", "chunk_length"]


def _no_chunk(kind: str) -> list:
    """The columns of a HOLE or FILL from its kind on."""
    zero = F.lit(0).cast("long")
    return [F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("chunk_id"), zero.alias("chunk_offset"), zero.alias("chunk_length")]


def partition_check(extents: DataFrame) -> DataFrame:
    """(file_id, logical_size, extents, valid): valid if extents follow each other from 0, none is empty and slices lie in their chunk."""
    by = Window.partitionBy("file_id").orderBy("ordinal")
    slice_ok = (F.col("kind") != "SLICE") | ((F.col("chunk_offset") >= 0) & (F.col("chunk_offset") + F.col("length") <= F.col("chunk_length")) & (F.col("length") < F.col("chunk_length")))
    good = (F.coalesce(F.lag(_end()).over(by), F.lit(0)) == F.col("logical_offset")) & (F.col("length") > 0) & slice_ok
    marked = extents.withColumn("good", good)
    return marked.groupBy("file_id").agg(F.max(_end()).alias("logical_size"), F.count("*").alias("extents"), F.bool_and("good").alias("valid"))


def range_read(extents: DataFrame, ranges: DataFrame) -> DataFrame:
    """Extents that overlap a range of their file, whole, with the range."""
    return extents.join(ranges, "file_id").where((F.col("logical_offset") < F.col("range_end")) & (_end() > F.col("range_start")))


def slice_extents(extents: DataFrame, ranges: DataFrame) -> DataFrame:
    """Extents clipped to a range of their file; a part of a chunk becomes a SLICE of it."""
    hit = range_read(extents, ranges)
    start = F.greatest("logical_offset", "range_start")
    end = F.least(_end(), F.col("range_end"))
    cut = (start > F.col("logical_offset")) | (end < _end())
    return hit.select(
        "file_id", "ordinal", start.alias("logical_offset"), (end - start).alias("length"),
        F.when((F.col("kind") == "DATA") & cut, F.lit("SLICE")).otherwise(F.col("kind")).alias("kind"),
        "chunk_id", (F.col("chunk_offset") + start - F.col("logical_offset")).alias("chunk_offset"), "chunk_length",
    )


def allocated_in_range(extents: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file_id, allocated): bytes of a range that are not holes, 0 for files without any."""
    cut = slice_extents(extents, ranges).where("kind != 'HOLE'").groupBy("file_id").agg(F.sum("length").alias("allocated"))
    return ranges.select("file_id").distinct().join(cut, "file_id", "left").select("file_id", F.coalesce("allocated", F.lit(0)).alias("allocated"))


def scan_summary(extents: DataFrame) -> DataFrame:
    """(file_id, logical_size, allocated, windows)"""
    return extents.groupBy("file_id").agg(
        F.max(_end()).alias("logical_size"),
        F.sum(F.when(F.col("kind") != "HOLE", F.col("length")).otherwise(0)).alias("allocated"),
        F.countDistinct(F.floor(F.col("logical_offset") / LEAF_WINDOW)).alias("windows"),
    )


def splice(extents: DataFrame, edits: DataFrame) -> DataFrame:
    """Replaces range [range_start, range_end) of each edited file by one FILL extent of new_length bytes (none if 0); what follows moves."""
    sized = edits.join(extents.groupBy("file_id").agg(F.max(_end()).alias("file_end")), "file_id")
    keep = ["file_id", "logical_offset", "length", "kind", "chunk_id", "chunk_offset", "chunk_length"]
    left = slice_extents(extents, sized.select("file_id", F.lit(0).alias("range_start"), F.col("range_start").alias("range_end"))).select(*keep)
    right = slice_extents(extents, sized.select("file_id", F.col("range_end").alias("range_start"), F.col("file_end").alias("range_end"))).select(*keep)
    shift = edits.select("file_id", (F.col("new_length") - (F.col("range_end") - F.col("range_start"))).alias("shift"))
    right = right.join(shift, "file_id").withColumn("logical_offset", F.col("logical_offset") + F.col("shift")).select(*keep)
    inside = sized.where("new_length > 0 AND range_start <= file_end").select(
        "file_id", F.col("range_start").alias("logical_offset"), F.col("new_length").alias("length"), F.lit("FILL").alias("kind"), F.lit(None).cast("string").alias("chunk_id"), F.lit(0).cast("long").alias("chunk_offset"), F.lit(0).cast("long").alias("chunk_length")
    )
    untouched = extents.join(edits.select("file_id"), "file_id", "left_anti").select(*keep)
    return left.unionByName(inside).unionByName(right).unionByName(untouched)


def rewrite(extents: DataFrame, edits: DataFrame, new: DataFrame, resize: bool = False) -> DataFrame:
    """Replaces a range (file_id, range_start, range_end) of each edited file by the extents ``new`` (offsets from 0, in their file); what follows
    moves by the difference. Unless ``resize``, new extents must be as long as the range: files where they are not, where the range is not within
    the file, or where both range and extents are empty, stay as they are.
    """
    ends = extents.groupBy("file_id").agg(F.max(_end()).alias("file_end"))
    sizes = new.groupBy("file_id").agg(F.max(_end()).alias("new_length"))
    sized = edits.join(ends, "file_id").join(sizes, "file_id", "left").withColumn("new_length", F.coalesce("new_length", F.lit(0).cast("long")))
    span = F.col("range_end") - F.col("range_start")
    good = (F.col("range_start") >= 0) & (span >= 0) & (F.col("range_end") <= F.col("file_end")) & ((span > 0) | (F.col("new_length") > 0))
    sized = sized.where(good if resize else good & (span == F.col("new_length"))).withColumn("shift", F.col("new_length") - span)
    inside = new.join(sized.select("file_id", "range_start"), "file_id").withColumn("logical_offset", F.col("logical_offset") + F.col("range_start")).select(*_RECIPE)
    # One pass over the extents: what lies before the range, and behind it, of those in an edited file; the others as they are.
    met = extents.join(sized.select("file_id", "range_start", "range_end", "file_end", "shift"), "file_id", "left")
    before = (F.col("logical_offset") < F.col("range_start")) & (_end() > 0)
    behind = (F.col("logical_offset") < F.col("file_end")) & (_end() > F.col("range_end"))
    zero = F.lit(0).cast("long")
    parts = F.array_compact(F.array(
        F.when(F.col("shift").isNull(), _piece(F.col("logical_offset"), _end(), zero)),
        F.when(before, _piece(F.greatest("logical_offset", zero), F.least(_end(), F.col("range_start")), zero)),
        F.when(behind, _piece(F.greatest("logical_offset", "range_end"), F.least(_end(), F.col("file_end")), F.col("shift"))),
    ))
    kept = met.select("file_id", F.explode(parts).alias("e"), "chunk_id", "chunk_length").select("file_id", "e.*", "chunk_id", "chunk_length").select(*_RECIPE)
    return kept.unionByName(inside)


def _piece(start, end, shift):
    """The part of an extent from ``start`` to ``end``, moved by ``shift``; a part of a chunk is a SLICE."""
    cut = (start > F.col("logical_offset")) | (end < _end())
    kind = F.when((F.col("kind") == "DATA") & cut, F.lit("SLICE")).otherwise(F.col("kind"))
    return F.struct((start + shift).alias("logical_offset"), (end - start).alias("length"), kind.alias("kind"), (F.col("chunk_offset") + start - F.col("logical_offset")).alias("chunk_offset"))


def read_pieces(extents: DataFrame, ranges: DataFrame, payload: DataFrame) -> DataFrame:
    """(file_id, logical_offset, length, bytes) of byte ranges through recipes: holes are zeros, a FILL is its byte (``fill_value``, 0 where that column
    is missing), DATA and SLICE are parts of payload (chunk_id, bytes). bytes is null where a chunk is missing or too short: the read must fail.

    A range is clipped to the file. Payload bytes are joined once by chunk and cut before they move on.
    """
    fill = F.coalesce(F.col("fill_value"), F.lit(0)) if "fill_value" in extents.columns else F.lit(0)
    hit = range_read(extents, ranges)
    start, end = F.greatest("logical_offset", "range_start"), F.least(_end(), F.col("range_end"))
    size = (end - start).cast("int")
    skip = (F.col("chunk_offset") + start - F.col("logical_offset")).cast("int")
    parts = hit.select("file_id", start.alias("at"), size.alias("size"), "kind", F.when(F.col("kind").isin("DATA", "SLICE"), F.col("chunk_id")).alias("chunk_id"), skip.alias("skip"), fill.alias("fill"))
    joined = parts.join(payload.select("chunk_id", F.col("bytes").alias("payload")), "chunk_id", "left")
    same = F.unhex(F.repeat(F.lpad(F.hex(F.when(F.col("kind") == "FILL", F.col("fill")).otherwise(0)), 2, "0"), F.col("size")))
    cut = F.when(F.octet_length("payload") >= F.col("skip") + F.col("size"), F.substring("payload", F.col("skip") + 1, F.col("size")))
    value = F.when(F.col("kind").isin("DATA", "SLICE"), cut).otherwise(same)
    return joined.select("file_id", F.col("at").alias("logical_offset"), F.col("size").cast("long").alias("length"), value.alias("bytes"))


def read_bytes(extents: DataFrame, ranges: DataFrame, payload: DataFrame, most: int = MAX_READ) -> DataFrame:
    """(file_id, bytes): one range of each file as one value; ranges of more than ``most`` bytes are refused (null), as are those with a missing chunk."""
    small = ranges.where(F.col("range_end") - F.col("range_start") <= most)
    pieces = read_pieces(extents, small, payload)
    whole = pieces.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("logical_offset", "bytes"))).alias("p"), F.bool_and(F.col("bytes").isNotNull()).alias("good"))
    text = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x.bytes)), ""))  # ``most`` bytes
    found = whole.select("file_id", F.when(F.col("good"), text).alias("b"), "good")
    asked = ranges.select("file_id", (F.col("range_end") - F.col("range_start") <= most).alias("_small"))
    empty = F.when(F.col("_small") & F.col("good").isNull(), F.unhex(F.lit("")))
    return asked.join(found, "file_id", "left").select("file_id", F.coalesce("b", empty).alias("bytes"))


def append(extents: DataFrame, more: DataFrame) -> DataFrame:
    """Adds extents (offsets from 0) at the end of their file."""
    ends = extents.groupBy("file_id").agg(F.max(_end()).alias("file_end"))
    moved = more.join(ends, "file_id", "left").withColumn("logical_offset", F.col("logical_offset") + F.coalesce("file_end", F.lit(0))).drop("file_end")
    return extents.unionByName(moved)


def truncate(extents: DataFrame, sizes: DataFrame) -> DataFrame:
    """Cuts each file to new_size; a larger size adds a HOLE."""
    ranges = sizes.select("file_id", F.lit(0).cast("long").alias("range_start"), F.col("new_size").alias("range_end"))
    kept = slice_extents(extents, ranges).select(*_RECIPE)
    ends = extents.groupBy("file_id").agg(F.max(_end()).alias("file_end"))
    hole = sizes.join(ends, "file_id", "left").where(F.col("new_size") > F.coalesce("file_end", F.lit(0)))
    start = F.coalesce("file_end", F.lit(0))
    return kept.unionByName(hole.select("file_id", start.alias("logical_offset"), (F.col("new_size") - start).alias("length"), *_no_chunk("HOLE")))


def leaves(extents: DataFrame) -> DataFrame:
    """Adds leaf: extents of one window of 64 MiB, at most 1024 in each leaf."""
    window = F.floor(F.col("logical_offset") / LEAF_WINDOW).cast("long")
    place = F.row_number().over(Window.partitionBy("file_id", "window").orderBy("logical_offset")) - 1
    return extents.withColumn("window", window).withColumn("leaf", F.floor(place / LEAF_EXTENTS).cast("long"))


def coalesce_ranges(ranges: DataFrame) -> DataFrame:
    """Union of the ranges of each file: disjoint, with touching ones merged. Empty ranges go."""
    by = Window.partitionBy("file_id").orderBy("range_start", "range_end")
    reach = F.max("range_end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = ranges.where("range_end > range_start").withColumn("new", (F.coalesce(F.col("range_start") > reach, F.lit(True))).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("file_id", "island").agg(F.min("range_start").alias("range_start"), F.max("range_end").alias("range_end")).drop("island")


def subtract_ranges(ranges: DataFrame, holes: DataFrame) -> DataFrame:
    """Ranges of each file without those in ``holes``: both are merged first."""
    a, b = coalesce_ranges(ranges), coalesce_ranges(holes)
    steps = [a.select("file_id", F.col("range_start").alias("at"), F.lit(1).alias("da"), F.lit(0).alias("db")), a.select("file_id", F.col("range_end").alias("at"), F.lit(-1).alias("da"), F.lit(0).alias("db"))]
    steps += [b.select("file_id", F.col("range_start").alias("at"), F.lit(0).alias("da"), F.lit(1).alias("db")), b.select("file_id", F.col("range_end").alias("at"), F.lit(0).alias("da"), F.lit(-1).alias("db"))]
    edges = steps[0].unionByName(steps[1]).unionByName(steps[2]).unionByName(steps[3]).groupBy("file_id", "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    by = Window.partitionBy("file_id").orderBy("at")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    cells = edges.select("file_id", F.col("at").alias("range_start"), F.lead("at").over(by).alias("range_end"), F.sum("da").over(upto).alias("a"), F.sum("db").over(upto).alias("b"))
    return coalesce_ranges(cells.where("a > 0 AND b = 0").select("file_id", "range_start", "range_end"))


def overlay(writes: DataFrame) -> DataFrame:
    """(file_id, range_start, range_end, seq): what is seen of each write when the last writer wins. Empty writes are not seen.

    A sweep over a file's starts and ends in order, with a heap of the writes that are open: n log n steps, and only the open writes
    are held. Neighbouring pieces of one write merge.
    """
    kind = {x.name: x.dataType.simpleString() for x in writes.schema.fields}
    names = ["file_id", "seq", "range_start", "range_end"]
    ends = F.explode(F.array(F.struct(F.col("range_start").alias("at"), F.lit(1).alias("opens")), F.struct(F.col("range_end").alias("at"), F.lit(0).alias("opens"))))
    edges = writes.where("range_end > range_start").select("file_id", "seq", ends.alias("e")).select("file_id", "seq", F.col("e.at").cast("long").alias("at"), "e.opens")

    def run(batches):
        file, open_, closed, since, top = None, [], {}, 0, None
        for batch in batches:
            out, types = [], batch.schema.types
            for f, seq, at, opens in zip(*(c.to_pylist() for c in batch.columns)):
                if f != file:
                    file, open_, closed, top = f, [], {}, None
                if opens:
                    heapq.heappush(open_, -seq)
                else:
                    closed[-seq] = closed.get(-seq, 0) + 1
                while open_ and closed.get(open_[0], 0):
                    closed[open_[0]] -= 1
                    if not closed[open_[0]]:
                        del closed[open_[0]]
                    heapq.heappop(open_)
                now = -open_[0] if open_ else None
                if now != top:
                    if top is not None and at > since:
                        out.append((f, top, since, at))
                        since = at
                    elif top is None:
                        since = at
                    top = now
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (types[0], types[1], pa.int64(), pa.int64()))], names=names)

    dealt = edges.repartition("file_id").sortWithinPartitions("file_id", "at", "opens", "seq")
    seen = dealt.mapInArrow(run, f"file_id {kind['file_id']}, seq {kind['seq']}, range_start long, range_end long")
    by = Window.partitionBy("file_id").orderBy("range_start")
    fresh = F.coalesce((F.lag("seq").over(by) != F.col("seq")) | (F.lag("range_end").over(by) != F.col("range_start")), F.lit(True)).cast("int")
    runs = seen.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("file_id", "run", "seq").agg(F.min("range_start").alias("range_start"), F.max("range_end").alias("range_end")).drop("run")


def layered_read(layers: DataFrame) -> DataFrame:
    """The view through layers (file_id, layer, seq, range_start, range_end): higher layers first, then later sequences."""
    order = F.row_number().over(Window.partitionBy("file_id").orderBy("layer", "seq")).cast("long")
    ranked = layers.withColumn("order", order)
    seen = overlay(ranked.select("file_id", F.col("order").alias("seq"), "range_start", "range_end"))
    return seen.withColumnRenamed("seq", "order").join(ranked.select("file_id", "order", "layer", "seq"), ["file_id", "order"]).drop("order")


def clone_range(extents: DataFrame, clones: DataFrame) -> DataFrame:
    """Adds a status to requests (clone_id, source_file, source_offset, target_file, target_offset, length).

    No payload moves. A hole in the source, or overlap inside one file, is UNSUPPORTED; a source beyond the end is INVALID; length 0 is a no-op.
    """
    ends = extents.groupBy(F.col("file_id").alias("source_file")).agg(F.max(_end()).alias("source_end"))
    same = (F.col("source_file") == F.col("target_file")) & (F.abs(F.col("source_offset") - F.col("target_offset")) < F.col("length"))
    ranges = clones.select("clone_id", F.col("source_file").alias("file_id"), F.col("source_offset").alias("range_start"), (F.col("source_offset") + F.col("length")).alias("range_end"))
    holes = range_read(extents.where("kind = 'HOLE'"), ranges).select("clone_id").distinct().withColumn("holes", F.lit(True))
    status = (
        F.when(same & (F.col("length") > 0), "UNSUPPORTED")
        .when(F.col("length") == 0, "OK")
        .when(F.col("source_offset") + F.col("length") > F.coalesce("source_end", F.lit(0)), "INVALID")
        .when(F.coalesce("holes", F.lit(False)), "UNSUPPORTED")
        .otherwise("OK")
    )
    return clones.join(ends, "source_file", "left").join(holes, "clone_id", "left").withColumn("status", status).drop("source_end", "holes")


def cloned_extents(extents: DataFrame, clones: DataFrame) -> DataFrame:
    """(clone_id, file_id, logical_offset, length, kind, chunk_id, chunk_offset, chunk_length): what the requests with status OK map into their targets;
    no payload moves. ``rewrite`` puts them there."""
    good = clone_range(extents, clones).where("status = 'OK' AND length > 0").select("clone_id", "source_file", "source_offset", "target_file", "target_offset", F.col("length").alias("span"))
    ranges = good.select("clone_id", "target_file", "target_offset", F.col("source_file").alias("file_id"), F.col("source_offset").alias("range_start"), (F.col("source_offset") + F.col("span")).alias("range_end"))
    hit = range_read(extents, ranges)
    start, end = F.greatest("logical_offset", "range_start"), F.least(_end(), F.col("range_end"))
    cut = (start > F.col("logical_offset")) | (end < _end())
    return hit.select(
        "clone_id", F.col("target_file").alias("file_id"), (F.col("target_offset") + start - F.col("range_start")).alias("logical_offset"), (end - start).alias("length"),
        F.when((F.col("kind") == "DATA") & cut, F.lit("SLICE")).otherwise(F.col("kind")).alias("kind"),
        "chunk_id", (F.col("chunk_offset") + start - F.col("logical_offset")).alias("chunk_offset"), "chunk_length",
    )


def clone_contract(requests: DataFrame) -> DataFrame:
    """Adds status: the checks of a clone request in their fixed order. Offsets whose end leaves the range of a long are invalid."""
    c = F.col
    aligned = lambda x: c(x) % c("alignment") == 0
    beyond = lambda x: c(x) > F.lit((1 << 63) - 1) - c("length")
    overlap = c("same_file") & (c("source_offset") < c("target_offset") + c("length")) & (c("target_offset") < c("source_offset") + c("length"))
    return requests.withColumn(
        "status",
        F.when((c("length") == 0) | (c("alignment") < 4096) | (F.bit_count("alignment") != 1) | (c("maximum_length") == 0), "INVALID_PARAMETER")
        .when(c("length") > c("maximum_length"), "CLONE_TOO_LARGE")
        .when(~(aligned("source_offset") & aligned("target_offset") & aligned("length")), "MISALIGNED")
        .when(beyond("source_offset") | beyond("target_offset"), "INVALID_PARAMETER")
        .when(c("source_offset") + c("length") > c("source_size"), "SOURCE_OUT_OF_BOUNDS")
        .when(c("target_offset") + c("length") > c("target_size"), "TARGET_NOT_PRESIZED")
        .when(overlap, "OVERLAP")
        .otherwise("OK"),
    )


def manifest_choice(manifests: DataFrame) -> DataFrame:
    """Adds choice: how a file's new recipe comes from its old one."""
    c = F.col
    return manifests.withColumn(
        "choice",
        F.when(c("old_size").isNull(), "COMPLETE")
        .when((c("changed_ranges") == 0) & (c("old_size") == c("new_size")), "REUSE")
        .when((c("changed_ranges") == 0) & (c("new_size") < c("old_size")), "TRUNCATE")
        .when((c("new_size") > c("old_size")) & ((c("changed_ranges") == 0) | (c("first_changed") >= c("old_size"))), "APPEND")
        .when(c("new_size") == c("old_size"), "REPLACE")
        .otherwise("COMPLETE"),
    )


def rechunk_ranges(dirty: DataFrame, extents: DataFrame, cell: int = 262144) -> DataFrame:
    """Ranges to chunk again: dirty ranges grow to cells, merge, grow over the DATA extents that they touch, and merge again."""
    out = dirty.select("file_id", (F.floor(F.col("range_start") / cell) * cell).cast("long").alias("range_start"), (F.ceil(F.col("range_end") / cell) * cell).cast("long").alias("range_end"))
    ends = extents.groupBy("file_id").agg(F.max(_end()).alias("file_end"))
    merged = coalesce_ranges(out.join(ends, "file_id").withColumn("range_end", F.least("range_end", "file_end")).drop("file_end"))
    touched = range_read(extents.where("kind = 'DATA'"), merged).select("file_id", F.col("logical_offset").alias("range_start"), _end().alias("range_end"))
    return coalesce_ranges(merged.unionByName(touched))
