"""Greedy packing: running sums that start anew when a limit is reached.

A running sum with resets is no window function. Rows are dealt by group and sorted inside partitions; one pass holds the current sums only, so
groups of any length fit.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame


def pack(rows: DataFrame, group: str, order: list[str], size: str, most_bytes: int, most_rows: int | None = None, breaks: str | None = None, name: str = "bin") -> DataFrame:
    """Adds the bin of each row within its group: a bin closes before the row that would exceed a limit, and before a row with ``breaks`` true.

    A row larger than the limit has a bin of its own.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{name}` long"])

    def run(batches):
        now, bin_no, total, count = object(), -1, 0, 0
        for batch in batches:
            groups, sizes = batch.column(group).to_pylist(), batch.column(size).to_pylist()
            cut = batch.column(breaks).to_pylist() if breaks else [False] * len(groups)
            bins = []
            for g, n, b in zip(groups, sizes, cut):
                if g != now:
                    now, bin_no, total, count = g, 0, 0, 0
                elif b or total + n > most_bytes or (most_rows and count >= most_rows):
                    bin_no, total, count = bin_no + 1, 0, 0
                total, count = total + n, count + 1
                bins.append(bin_no)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins, pa.int64())], names=[*batch.schema.names, name])

    return rows.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)


def flush_bins(rows: DataFrame, group: str, order: list[str], size: str, threshold: int = 32 * 1024 * 1024 - 256 * 1024, name: str = "container") -> DataFrame:
    """Adds the container of each row: one is closed once it has reached ``threshold`` bytes."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{name}` long"])

    def run(batches):
        now, bin_no, total = object(), 0, 0
        for batch in batches:
            bins = []
            for g, n in zip(batch.column(group).to_pylist(), batch.column(size).to_pylist()):
                if g != now:
                    now, bin_no, total = g, 0, 0
                elif total >= threshold:
                    bin_no, total = bin_no + 1, 0
                total += n
                bins.append(bin_no)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins, pa.int64())], names=[*batch.schema.names, name])

    return rows.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, schema)
