"""Inputs of the queries, derived from the star-schema tables by expressions that Spark and DuckDB both read.

Each entry: name -> (source table, select list). ``frame`` gives the DataFrame, ``cte`` the same for the SQL side.
"""

from __future__ import annotations

import re

_LINES = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"

DERIVED: dict[str, tuple[str, list[str]]] = {
    # Sorted-run entries: chunk -> physical place, with a transition in each generation.
    "entries": (
        "lineitem",
        [
            "md5(CAST(l_partkey AS STRING)) AS chunk_id",
            "CAST(4096 + 1024 * (l_partkey % 7) AS BIGINT) AS logical_length",
            "concat('c', CAST(l_suppkey % 97 AS STRING)) AS container_id",
            "CAST(64 * (l_orderkey % 5) AS BIGINT) AS record_offset",
            "CAST(l_linenumber % 3 AS BIGINT) AS chunk_ordinal",
            "CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS generation",
            "CAST(l_linenumber % 4 AS BIGINT) AS level",
            "CASE l_returnflag WHEN 'R' THEN 'RETIRING' WHEN 'A' THEN 'REMOVED' ELSE 'ACTIVE' END AS transition",
        ],
    ),
    # Extents of recipes: one file for each order; lengths follow the quantity, kinds the line number.
    "extents": (
        "lineitem",
        [
            "CAST(l_orderkey AS BIGINT) AS file_id",
            f"CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINES}) - 1 AS BIGINT) AS ordinal",
            f"CAST(coalesce(sum(CAST(l_quantity * 512 AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY {_LINES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS logical_offset",
            "CAST(l_quantity * 512 AS BIGINT) AS length",
            "CASE l_partkey % 4 WHEN 0 THEN 'HOLE' WHEN 1 THEN 'FILL' WHEN 2 THEN 'SLICE' ELSE 'DATA' END AS kind",
            "md5(CAST(l_partkey AS STRING)) AS chunk_id",
            "CAST(CASE WHEN l_partkey % 4 = 2 THEN 512 ELSE 0 END AS BIGINT) AS chunk_offset",
            "CAST(l_quantity * 512 + CASE WHEN l_partkey % 4 = 2 THEN 1024 ELSE 0 END AS BIGINT) AS chunk_length",
        ],
    ),
    # One byte range for each file.
    "ranges": ("orders", ["CAST(o_orderkey AS BIGINT) AS file_id", "CAST(300 * (o_custkey % 50) AS BIGINT) AS range_start", "CAST(300 * (o_custkey % 50) + 5000 AS BIGINT) AS range_end"]),
    # Dirty ranges of files: several for each, overlapping and touching.
    "dirty": ("lineitem", ["CAST(l_suppkey AS BIGINT) AS file_id", "CAST(1024 * (l_partkey % 300) AS BIGINT) AS range_start", "CAST(1024 * (l_partkey % 300 + l_linenumber) AS BIGINT) AS range_end"]),
    # Writes to files in the order of a sequence.
    "writes": ("events", ["CAST(user_id AS BIGINT) AS file_id", "CAST(event_id AS BIGINT) AS seq", "CAST(event_id * 37 % 4000 AS BIGINT) AS range_start", "CAST(event_id * 37 % 4000 + 100 + event_id % 900 AS BIGINT) AS range_end"]),
    # Commit log: one record for each order, some broken.
    "commit_log": (
        "orders",
        [
            "CAST(o_custkey % 20 AS BIGINT) AS log_id",
            "CAST(row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS BIGINT) AS position",
            "CAST(row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) + CASE WHEN o_orderkey % 211 = 0 THEN 1 ELSE 0 END AS BIGINT) AS generation",
            "md5(CAST(o_orderkey AS STRING)) AS record_hash",
            "CASE WHEN o_orderkey % 173 = 0 THEN 'x' ELSE lag(md5(CAST(o_orderkey AS STRING))) OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) END AS previous_hash",
            "CAST(row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) * 10 AS BIGINT) AS mutation_cutoff",
            "CAST(row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) + 100 - CASE WHEN o_orderkey % 389 = 0 THEN 7 ELSE 0 END AS BIGINT) AS reservation_end",
            "CAST(row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) + 2 - CASE WHEN o_orderkey % 401 = 0 THEN 7 ELSE 0 END AS BIGINT) AS allocation_cursor",
            "CAST(o_orderkey % 307 <> 0 AS BOOLEAN) AS checksum_ok",
            "CAST(o_orderkey % 419 = 0 AS BOOLEAN) AS torn",
        ],
    ),
    # Inodes by generation (the month of an order): mutation sequence, manifest.
    "inodes": (
        "orders",
        [
            "CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS generation",
            "CAST(o_custkey AS BIGINT) AS inode",
            "CAST(o_orderkey AS BIGINT) AS mutation_sequence",
            "CAST(o_totalprice AS BIGINT) AS logical_size",
            "md5(CAST(o_custkey % 40 AS STRING)) AS manifest_root",
        ],
    ),
    # Chunks that generations need: (generation, chunk, length).
    "required": (
        "lineitem",
        ["CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS generation", "md5(CAST(l_partkey AS STRING)) AS chunk_id", "CAST(4096 + 1024 * (l_partkey % 7) AS BIGINT) AS logical_length"],
    ),
    # Chunks by container.
    "container_chunks": (
        "lineitem",
        [
            "concat('c', CAST(l_orderkey % 499 AS STRING)) AS container_id",
            "CAST(l_linenumber AS BIGINT) AS chunk_ordinal",
            "md5(CAST(l_partkey AS STRING)) AS chunk_id",
            "CAST(4096 + 1024 * (l_partkey % 7) AS BIGINT) AS logical_length",
        ],
    ),
    "namespace_names": ("customer", ["CAST(c_nationkey AS BIGINT) AS parent", "CAST(c_custkey AS BIGINT) AS target", "c_name AS name"]),
    # Requests to clone ranges.
    "clone_requests": (
        "lineitem",
        [
            "CAST(l_orderkey AS BIGINT) AS request_id",
            "CAST(l_linenumber AS BIGINT) AS line",
            "CAST(4096 * (l_partkey % 50) AS BIGINT) AS source_size",
            "CAST(4096 * (l_suppkey % 60) AS BIGINT) AS target_size",
            "CAST(CASE WHEN l_partkey % 37 = 0 THEN 9223372036854771712 ELSE 4096 * (l_partkey % 13) + (l_linenumber + l_suppkey) % 5 // 4 END AS BIGINT) AS source_offset",
            "CAST(4096 * (l_suppkey % 11) AS BIGINT) AS target_offset",
            "CAST(4096 * (l_orderkey % 20) AS BIGINT) AS length",
            "CAST(4096 * (1 + l_linenumber % 2) - CASE WHEN l_orderkey % 9 = 0 THEN 1 ELSE 0 END AS BIGINT) AS alignment",
            "CAST(CASE WHEN l_suppkey % 23 = 0 THEN 0 ELSE 4096 * 16 END AS BIGINT) AS maximum_length",
            "CAST(l_partkey % 3 = 0 AS BOOLEAN) AS same_file",
        ],
    ),
    "manifests": (
        "orders",
        [
            "CAST(o_orderkey AS BIGINT) AS file_id",
            "CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE CAST(1000 * (o_custkey % 9) AS BIGINT) END AS old_size",
            "CAST(1000 * (o_orderkey % 9) AS BIGINT) AS new_size",
            "CAST(o_custkey % 3 AS BIGINT) AS changed_ranges",
            "CAST(1000 * (o_custkey % 8) AS BIGINT) AS first_changed",
        ],
    ),
    "trigger_states": (
        "events",
        [
            "CAST(event_id AS BIGINT) AS event_id",
            "CAST(event_id * 113 % 7000 AS BIGINT) AS dirty_age_ms",
            "CAST(event_id % 10 AS BIGINT) AS sealed",
            "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id * 31 % 900 AS BIGINT) END AS container_age_ms",
        ],
    ),
    "pool_usage": ("customer", ["CAST(c_custkey AS BIGINT) AS pool_id", "CAST(800 + c_custkey % 200 AS BIGINT) AS used", "CAST(1000 AS BIGINT) AS capacity", "CAST(c_custkey % 400 AS BIGINT) AS reclaimable", "CAST(CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 1000 END AS BIGINT) AS container_bytes"]),
    "records": ("lineitem", ["CAST(l_orderkey AS BIGINT) AS record_id", "CAST(l_linenumber AS BIGINT) AS line", "CAST(l_quantity * 4096 AS BIGINT) AS raw_bytes", "CAST(floor(l_quantity * 4096 * (1 - l_discount * 2)) AS BIGINT) AS payload_bytes", "CAST(1 + l_partkey % 8 AS BIGINT) AS chunks"]),
    "fence_events": ("events", ["CAST(user_id AS BIGINT) AS handle", "CAST(event_id AS BIGINT) AS seq", "CASE WHEN event_id % 3 = 0 THEN 'complete' ELSE 'accept' END AS op", "CAST(row_number() OVER (PARTITION BY user_id, event_id % 3 = 0 ORDER BY event_id) + CASE WHEN event_id % 31 = 0 THEN 1 ELSE 0 END AS BIGINT) AS sequence"]),
    # Names and roots by generation (a month of orders).
    "roots": (
        "(SELECT DISTINCT year(o_orderdate) * 12 + month(o_orderdate) AS g FROM orders)",
        [
            "CAST(row_number() OVER (ORDER BY g) AS BIGINT) AS generation",
            "CAST(100 * row_number() OVER (ORDER BY g) - CASE WHEN g % 17 = 0 THEN 150 ELSE 0 END AS BIGINT) AS mutation_sequence",
            "CAST(40 * row_number() OVER (ORDER BY g) - CASE WHEN g % 19 = 0 THEN 75 ELSE 0 END AS BIGINT) AS reservation_end",
            "CAST(30 * row_number() OVER (ORDER BY g) - 28 + CASE WHEN g % 23 = 0 THEN 45 ELSE 0 END AS BIGINT) AS allocation_cursor",
        ],
    ),
    "root_inodes": (
        "(SELECT DISTINCT l_partkey % 900 AS p, year(l_shipdate) * 12 + month(l_shipdate) AS g FROM lineitem)",
        ["CAST(1 + dense_rank() OVER (ORDER BY g) AS BIGINT) AS generation", "CAST(p + 2 AS BIGINT) AS inode", "CAST(g * 10 + p - CASE WHEN p % 29 = 0 THEN 20 * (g % 3) ELSE 0 END AS BIGINT) AS mutation_sequence"],
    ),
    # Clones of ranges between the files of extents, some within one file.
    "clones": (
        "orders",
        [
            "CAST(o_orderkey AS BIGINT) AS clone_id", "CAST(o_orderkey AS BIGINT) AS source_file", "CAST(512 * (o_custkey % 20) AS BIGINT) AS source_offset",
            "CAST(o_orderkey + o_custkey % 3 AS BIGINT) AS target_file", "CAST(512 * (o_custkey % 11) AS BIGINT) AS target_offset", "CAST(300 * (o_custkey % 30) AS BIGINT) AS length",
        ],
    ),
    "phases": ("events", ["CAST(user_id % 9 AS BIGINT) AS checkpoint", "event_type AS phase", "CAST(event_id % 91 AS BIGINT) AS wall_ms", "CAST(event_id % 57 AS BIGINT) AS cpu_ms", "CAST(event_id % 4096 AS BIGINT) AS bytes"]),
    "accesses": ("events", ["CAST(user_id AS BIGINT) AS cache", "event_type AS kind", "CAST(event_id % 4 <> 0 AS BOOLEAN) AS hit", "CAST(event_id * 17 % 1000 AS BIGINT) AS latency_ms"]),
}


#: Bytes of a table, as Spark's statistics have them, for which a dealt table gets one more partition.
DEAL_BYTES = 1 << 20


def frame(spark, sf_dir: str, name: str, deal: str | None = None):
    """The table; ``deal`` names the column by which its windows go, of many values: a larger table is dealt by it to more partitions, so that what a task sorts
    does not grow with the table, whatever the session's number of partitions is."""
    table, columns = DERIVED[name]
    columns = [c.replace(" // ", " DIV ") for c in columns]
    if not table.startswith("("):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        parts = -(-int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // DEAL_BYTES) if deal else 0
        return (rows.repartition(parts, deal) if parts > spark.sparkContext.defaultParallelism else rows).selectExpr(*columns)
    inner = re.sub(r"FROM (\w+)\)", lambda m: f"FROM parquet.`{sf_dir}/{m[1]}.parquet`)", table)
    return spark.sql(f"SELECT {', '.join(columns)} FROM {inner}")


def extents(spark, sf_dir: str):
    """The extents with their offsets, dealt by file."""
    return frame(spark, sf_dir, "extents", "l_orderkey")


def cte(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS (SELECT {', '.join(DERIVED[n][1])} FROM {DERIVED[n][0]})" for n in names)
