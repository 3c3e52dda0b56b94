"""Encodings of regions: raw, zstd, dictionaries and the gate for incompressible data, with the rules that choose between them."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.report import payload_cap, raw_record_bytes, zstd_accepts

#: Regions below this size go straight to zstd.
GATE_BYTES = 128 * 1024
DEPENDENCY = 32


def _sizes(regions: DataFrame, run, extra: str) -> DataFrame:
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in regions.schema.fields), extra])
    return regions.mapInArrow(run, schema)


def encode(regions: DataFrame, level: int = 3) -> DataFrame:
    """Adds encoding, payload_bytes and payload to rows with bytes: a zstd frame where it saves enough, else the raw bytes."""

    def run(batches):
        codec = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            frames = [codec.compress(x) for x in batch.column("bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(frames, pa.binary())], names=[*batch.schema.names, "frame"])

    framed = _sizes(regions, run, "frame binary")
    raw, packed = F.octet_length("bytes").cast("long"), F.octet_length("frame").cast("long")
    good = zstd_accepts(raw, packed)
    return framed.select(*regions.columns, F.when(good, "ZSTD").otherwise("RAW").alias("encoding"), F.when(good, packed).otherwise(raw).alias("payload_bytes"), F.when(good, F.col("frame")).otherwise(F.col("bytes")).alias("payload"))


def decode(records: DataFrame, size: str = "raw_bytes") -> DataFrame:
    """(record columns, bytes): payloads back to bytes; a frame must give exactly ``size`` bytes."""

    def run(batches):
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for kind, payload, n in zip(*(batch.column(c).to_pylist() for c in ("encoding", "payload", size))):
                raw = codec.decompress(payload, max_output_size=n) if kind == "ZSTD" else payload
                if len(raw) != n:
                    raise ValueError(f"a record gives {len(raw)} bytes, not {n}")
                out.append(raw)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "bytes"])

    return _sizes(records, run, "bytes binary")


def gate(regions: DataFrame, mode: str = "v1") -> DataFrame:
    """Adds cap and decision: what a cheap trial says of each region (bytes, chunks[, raw_records]): BYPASS, ZSTD_TRIAL or RAW.

    lz4 must fit the largest payload that still wins over the chunks' raw records (``raw_records``, their size; that of one chunk where the column is
    missing); otherwise, in mode ``v1``, zstd of level 1 may rescue the region. ``off`` tries all, ``lz4`` has no rescue.
    """
    raw = F.col("raw_records") if "raw_records" in regions.columns else raw_record_bytes(F.octet_length("bytes").cast("long"))
    capped = regions.withColumn("cap", payload_cap(raw, F.col("chunks")))

    def run(batches):
        fast, rescue = pa.Codec("lz4_raw"), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            out = []
            for raw, cap in zip(batch.column("bytes").to_pylist(), batch.column("cap").to_pylist()):
                if mode == "off" or len(raw) < GATE_BYTES:
                    out.append("BYPASS")
                elif len(fast.compress(raw, asbytes=True)) <= cap or (mode == "v1" and len(rescue.compress(raw)) <= cap):
                    out.append("ZSTD_TRIAL")
                else:
                    out.append("RAW")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "decision"])

    return _sizes(capped, run, "decision string")


def gate_metrics(decided: DataFrame, *by: str) -> DataFrame:
    """Regions and bytes of each decision of the gate, and bytes that it kept from the codec."""
    size = F.octet_length("bytes").cast("long")
    return decided.groupBy(*by).agg(
        F.count_if(F.col("decision") == "BYPASS").alias("bypassed"), F.count_if(F.col("decision") == "ZSTD_TRIAL").alias("allowed"), F.count_if(F.col("decision") == "RAW").alias("rejected"),
        F.sum(size).alias("bytes"), F.sum(F.when(F.col("decision") == "RAW", size).otherwise(0)).alias("rejected_bytes"), F.max(size).alias("largest"),
    )


def gated_encode(regions: DataFrame, mode: str = "v1", level: int = 3) -> DataFrame:
    """``encode`` behind the gate: regions that it rejects stay raw without a trial."""
    decided = gate(regions, mode)
    tried = encode(decided.where("decision <> 'RAW'"), level)
    raw = decided.where("decision = 'RAW'").select("*", F.lit("RAW").alias("encoding"), F.octet_length("bytes").cast("long").alias("payload_bytes"), F.col("bytes").alias("payload"))
    return tried.unionByName(raw.select(*tried.columns))


def with_checksum(records: DataFrame) -> DataFrame:
    """Adds checksum, the CRC-32 of a record's payload."""
    return records.withColumn("checksum", F.crc32("payload"))


def checksum_faults(records: DataFrame) -> DataFrame:
    """Records whose payload does not have their checksum; must be empty."""
    return records.where(~F.col("checksum").eqNullSafe(F.crc32("payload")))


def location_faults(locations: DataFrame, payload: DataFrame) -> DataFrame:
    """(chunk_id, container_id, chunk_ordinal, fault) of places (chunk_id, logical_length, container_id, chunk_ordinal) whose bytes (container_id, chunk_ordinal, bytes) are
    MISSING, of another LENGTH, or have another ID; must be empty."""
    joined = locations.join(payload.select("container_id", "chunk_ordinal", "bytes"), ["container_id", "chunk_ordinal"], "left")
    fault = F.when(F.col("bytes").isNull(), "MISSING").when(F.octet_length("bytes") != F.col("logical_length"), "LENGTH").when(F.sha2("bytes", 256) != F.col("chunk_id"), "ID")
    return joined.select("chunk_id", "container_id", "chunk_ordinal", fault.alias("fault")).where("fault IS NOT NULL")


def candidate_costs(candidates: DataFrame) -> DataFrame:
    """(region, encoding, cost, rejected, rejected_bytes): the cheapest complete cost of each region among its trials (region, encoding, payload_bytes, overhead); ties go
    to the first name. ``rejected`` counts the trials that lost."""
    cost = candidates.withColumn("cost", F.col("payload_bytes") + F.col("overhead"))
    best = cost.groupBy("region").agg(F.min(F.struct("cost", "encoding")).alias("b"), (F.count("*") - 1).alias("rejected"), F.sum("cost").alias("all"))
    return best.select("region", "b.encoding", "b.cost", "rejected", (F.col("all") - F.col("b.cost")).alias("rejected_bytes"))


def train_dictionary(samples: DataFrame, size: int = 65536, most_bytes: int = 64 << 20) -> bytes:
    """A dictionary from the samples (ord, bytes) in order, up to ``most_bytes`` of them: the bound of what reaches the driver."""
    if not 256 <= size <= 1 << 20:
        raise ValueError("a dictionary has 256 bytes to 1 MiB")
    total, taken = 0, []
    for row in samples.orderBy("ord").select("bytes").toLocalIterator():
        total += len(row.bytes)
        if total > most_bytes:
            break
        taken.append(bytes(row.bytes))
    return zstandard.train_dictionary(size, taken).as_bytes()


def dictionary_trial(regions: DataFrame, dictionary: bytes, level: int = 3) -> DataFrame:
    """Adds plain_bytes, dictionary_bytes (with its dependency) and choice: the smaller complete cost."""
    shared = regions.sparkSession.sparkContext.broadcast(dictionary)  # 1 MiB at most

    def run(batches):
        plain = zstandard.ZstdCompressor(level=level)
        with_it = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(shared.value))
        for batch in batches:
            rows = batch.column("bytes").to_pylist()
            a, b = [len(plain.compress(x)) for x in rows], [len(with_it.compress(x)) + DEPENDENCY for x in rows]
            choice = ["DICTIONARY" if y < x else "PLAIN" for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(choice)], names=[*batch.schema.names, "plain_bytes", "dictionary_bytes", "choice"])

    return _sizes(regions, run, "plain_bytes long, dictionary_bytes long, choice string")
