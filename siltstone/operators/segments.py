"""Content-defined chunks of objects as rows, and byte ranges of objects."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.cdc import CdcProfile, fingerprint, segments

#: A worker hands on what it has made of so many bytes and rows.
FLUSH_BYTES, FLUSH_ROWS = 4 << 20, 4096
#: What ``prints`` adds to chunks.
PRINTS = "features array<string>, sketch array<long>"


def print_columns(found: list) -> list[pa.Array]:
    """The columns of fingerprints (features, sketch), null for None: features as 16 hex digits, which sort as unsigned words; sketch as signed words."""
    features = pa.array([None if x is None else [f"{int(v):016x}" for v in x[0]] for x in found], pa.list_(pa.string()))
    return [features, pa.array([None if x is None else x[1].view("int64").tolist() for x in found], pa.list_(pa.int64()))]


def content_chunks(objects: DataFrame, profile: CdcProfile = CdcProfile(), fill_bytes: int | None = 65536, with_bytes: bool = True, whole_fill: bool = False, prints: bool = False) -> DataFrame:
    """(object_id, ordinal, input_offset, length, kind, fill_value, chunk_id[, bytes][, features, sketch]) of rows (object_id, bytes).

    Objects are cut where they are read: nothing is shuffled, and a worker holds one object beside its batch and what it has not yet handed on.
    ``whole_fill`` also turns a chunk of one byte value into a FILL, whatever its length; ``prints`` adds the fingerprints of DATA chunks.
    """
    kind = objects.schema["object_id"].dataType.simpleString()
    schema = f"object_id {kind}, ordinal int, input_offset long, length long, kind string, fill_value int, chunk_id string" + (", bytes binary" if with_bytes else "") + (f", {PRINTS}" if prints else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string()]

    def made(batch, rows):
        columns = list(zip(*rows)) or [()] * 9
        own = [pa.array(c, t) for c, t in zip(columns[1:7], types)] + ([pa.array(columns[7], pa.binary())] if with_bytes else []) + (print_columns(columns[8]) if prints else [])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *own], names=names)

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for i, value in enumerate(batch.column(1)):
                raw = value.as_py()
                if not raw:
                    continue
                found = segments(raw, profile, fill_bytes)
                if whole_fill:
                    found = [("FILL", a, b, raw[a]) if k == "DATA" and raw.count(raw[a : a + 1], a, b) == b - a else (k, a, b, v) for k, a, b, v in found]
                for ordinal, (k, a, b, v) in enumerate(found):
                    part = raw[a:b] if k == "DATA" else None
                    rows.append((i, ordinal, a, b - a, k, v, hashlib.sha256(part).hexdigest() if part is not None else None, part if with_bytes else None, fingerprint(part) if prints and part else None))
                held += len(raw)
                if held >= FLUSH_BYTES or len(rows) >= FLUSH_ROWS:
                    yield made(batch, rows)
                    rows, held = [], 0
            yield made(batch, rows)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return objects.select("object_id", "bytes").mapInArrow(run, schema)


def byte_ranges(objects: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows of ``ranges`` (object_id, input_offset, raw_bytes, ...) with the bytes of the range.

    An object's ranges are gathered beside it, so its bytes move once, and only those of objects with a range.
    """
    rest = [f for f in ranges.schema.fields if f.name != "object_id"]
    plan = ranges.groupBy("object_id").agg(F.collect_list(F.struct(*[f.name for f in rest])).alias("ranges"))
    kind = objects.schema["object_id"].dataType.simpleString()
    schema = ", ".join([f"object_id {kind}", *(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "bytes binary"])

    def made(batch, at, values, data):
        own = pa.array(values, batch.column(2).type.value_type)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *own.flatten(), pa.array(data, pa.binary())], names=["object_id", *(f.name for f in rest), "bytes"])

    def run(batches):
        for batch in batches:
            at, values, data, held = [], [], [], 0
            for i, (value, found) in enumerate(zip(batch.column(1), batch.column(2))):
                raw = value.as_py()
                for x in found.as_py():
                    part = raw[x["input_offset"] : x["input_offset"] + x["raw_bytes"]]
                    at.append(i)
                    values.append(x)
                    data.append(part)
                    held += len(part)
                    if held >= FLUSH_BYTES or len(at) >= FLUSH_ROWS:
                        yield made(batch, at, values, data)
                        at, values, data, held = [], [], [], 0
            yield made(batch, at, values, data)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return objects.select("object_id", "bytes").join(plan, "object_id").mapInArrow(run, schema)
