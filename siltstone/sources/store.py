"""Sources and sinks: objects from Parquet columns or binary files, containers, metadata objects, a commit log that makes a write visible.

A write stages its files in a folder of its own and becomes visible when its record is appended to the log; readers follow the last record of
the log's valid prefix, so a lost job leaves the old state or the new one, never a mixture.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.generations import decode_log

LOG = "generation long, path string, previous_hash string, record_hash string, mutation_cutoff long"
#: Bytes of one bounded read.
MOST_READ = 1 << 20


def objects_from_files(spark: SparkSession, path: str) -> DataFrame:
    """(object_id, bytes, length): whole files; the id is the path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("object_id"), F.col("content").alias("bytes"), "length")


def read_range(objects: DataFrame, offset: int, length: int) -> DataFrame:
    """(object_id, bytes): exactly ``length`` bytes from ``offset``; objects that are shorter give null, never a part."""
    if not 0 <= length <= MOST_READ:
        raise ValueError(f"a read has 0 to {MOST_READ} bytes")
    part = F.substring(F.col("bytes"), offset + 1, length)
    return objects.select("object_id", F.when(F.octet_length("bytes") >= offset + length, part).alias("bytes"))


class Store:
    """A folder with containers, metadata objects and the log of their generations."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, path: str, schema: str | None = None) -> DataFrame | None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], schema) if schema else None
        return self.spark.read.schema(schema).parquet(path) if schema else self.spark.read.parquet(path)

    def log(self) -> DataFrame:
        """The log's records with valid: part of the unbroken prefix."""
        records = self._read(f"{self.root}/log", LOG)
        payload = F.concat_ws("|", "generation", "path", F.coalesce("previous_hash", F.lit("")), "mutation_cutoff")
        checked = records.withColumn("log_id", F.lit(0)).withColumn("position", F.col("generation")).withColumn("checksum_ok", F.sha2(payload, 256) == F.col("record_hash"))
        return decode_log(checked)

    def current(self) -> tuple[int, str, str] | None:
        """(generation, path, record hash) of the newest valid record."""
        row = self.log().where("valid").orderBy(F.col("generation").desc()).select("generation", "path", "record_hash").first()
        return (row.generation, row.path, row.record_hash) if row else None

    def _file(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def claim(self, generation: int) -> None:
        """Takes the right to write a generation; an error where another publisher has it. A claim that a dead process left goes by ``release``."""
        fs, target = self._file(f"{self.root}/claims/{generation:012d}")
        fs.mkdirs(target.getParent())
        if not fs.createNewFile(target):
            raise RuntimeError(f"another publisher writes generation {generation}")

    def release(self, generation: int) -> None:
        fs, target = self._file(f"{self.root}/claims/{generation:012d}")
        fs.delete(target, False)

    def publish(self, table: DataFrame, cutoff: int = 0, fail_before_log: bool = False) -> int:
        """Writes a table and makes it the current generation. ``fail_before_log`` stops where a crash would hurt most.

        The input is evaluated once: its rows are counted as they are written, and the files must hold as many.
        """
        last = self.current()
        generation, before = (last[0] + 1, last[2]) if last else (1, None)
        self.claim(generation)
        try:
            if self.current() != last:
                raise RuntimeError(f"another publisher has written generation {generation}")
            return self._publish(table, generation, before, cutoff, fail_before_log)
        finally:
            self.release(generation)

    def _publish(self, table: DataFrame, generation: int, before: str | None, cutoff: int, fail_before_log: bool) -> int:
        path, written = f"{self.root}/data/{generation:012d}-{uuid.uuid4().hex}", Observation()
        table.observe(written, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        if self.spark.read.parquet(path).count() != written.get["rows"]:
            raise OSError(f"{path} does not hold what was written")
        if fail_before_log:
            raise RuntimeError("stopped before the log record")
        payload = F.concat_ws("|", "generation", "path", F.coalesce("previous_hash", F.lit("")), "mutation_cutoff")
        record = self.spark.createDataFrame([(generation, path, before, cutoff)], "generation long, path string, previous_hash string, mutation_cutoff long")
        record.withColumn("record_hash", F.sha2(payload, 256)).select(*[x.split()[0] for x in LOG.split(", ")]).coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        return generation

    def read(self, generation: int | None = None) -> DataFrame:
        """The current table, or that of an earlier generation of the valid prefix."""
        rows = self.log().where("valid")
        row = (rows.where(F.col("generation") == generation) if generation else rows.orderBy(F.col("generation").desc())).select("path").first()
        if row is None:
            raise LookupError("the store has no such generation")
        return self.spark.read.parquet(row.path)

    def put_metadata(self, objects: DataFrame) -> DataFrame:
        """Adds metadata objects (kind, payload) under their content id; those that are there stay. Returns (object_id, kind, payload)."""
        named = objects.withColumn("object_id", metadata_id(F.col("kind"), F.col("payload"))).dropDuplicates(["object_id"])
        there = self._read(f"{self.root}/metadata", "object_id string, kind string, payload binary")
        named.join(there.select("object_id"), "object_id", "left_anti").select("object_id", "kind", "payload").write.mode("append").parquet(f"{self.root}/metadata")
        return named.select("object_id", "kind", "payload")

    def get_metadata(self, ids: DataFrame) -> DataFrame:
        """(object_id, kind, payload, verified) of the asked ids; verified: the id is that of the bytes."""
        there = self._read(f"{self.root}/metadata", "object_id string, kind string, payload binary")
        return ids.select("object_id").distinct().join(there, "object_id").withColumn("verified", metadata_id(F.col("kind"), F.col("payload")) == F.col("object_id"))


def metadata_id(kind, payload):
    """Content id of a metadata object: a hash over domain, kind, length and bytes."""
    return F.sha2(F.concat(F.encode(F.concat_ws("|", F.lit("siltstone-metadata-v1"), kind, F.octet_length(payload).cast("string"), F.lit("")), "UTF-8"), payload), 256)


def inventory(spark: SparkSession, version: int, base: int = 3200) -> DataFrame:
    """(version, id, tenant, revision, payload): one JSON record for each id of a generated inventory in three related versions.

    Version 3 drops some ids and appends 24.
    """
    if version not in (1, 2, 3):
        raise ValueError("versions are 1, 2 and 3")
    ids = spark.range(base + (24 if version == 3 else 0))
    if version == 3:
        ids = ids.where(f"id >= {base} OR id % 487 != 0")
    changed = (F.col("id") % 37 == 0) | (F.lit(version == 3) & (F.col("id") % 113 == 0))
    rows = ids.select(F.lit(version).alias("version"), "id", (F.col("id") * 17 % 211).alias("tenant"), (F.col("id") % 23 + changed.cast("int") * version * 1000).alias("revision"))
    return rows.withColumn("payload", F.to_json(F.struct("id", "tenant", "revision", F.concat(F.lit("/srv/"), "tenant", F.lit("/vm-"), "id").alias("path"))))
