"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target T and size S is worth T / S copies: the whole part is sure, the fraction is a probability. Within
blocks of a source, documents meet in pairs of similar size; mass moves at random between the two, in words, so that the expected
number of words stays, until one probability is 0 or 1. A block leaves one fraction at most. These residuals meet in the next level of a
reduction tree, until a source has one left, which a last draw settles; so a source is off its target by less than one document.

Blocks come from a hash of the document and draws from a hash of the block, so reruns agree whatever the partitioning. The tree has
log(rows) / log(block size) levels; each level is one shuffle of the rows that still hold a fraction.

Defined cases: a null text has size 0 and gives no words; a null source is a source of its own, the last; repeated rows are documents of
their own, and which of them is taken is a tie that changes no result; very long texts only count their words; an empty table gives no rows; where all sizes
are 0 every target is 0; a kept column with the name of one of the operator's own gives way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, documents, packed, unpacked

#: Weights of the sources in turn.
WEIGHTS = (5, 2, 1)
#: No source gives more than so many times its size.
MOST = 3.0
#: Rows of a block, about.
BLOCK = 4096


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.0, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds weight and target to (source, source_size): one row for each source.

    Sources in the order of their code points, null last, take the weights in turn. The level of water that fills all sources by weight
    up to their limits is found by repeated sums over this table; each round fixes the sources that are full.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    table = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    table = table.withColumn("limit", F.col("source_size") * F.lit(most)).cache()
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = None, F.lit(False)
    while True:
        got = table.agg(F.sum(F.when(full, F.col("limit"))).alias("fixed"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not got.open:
            break
        new = max(0.0, total - (got.fixed or 0.0)) / got.open
        if level is not None and new <= level:
            break
        level = new
        full = F.col("limit") <= F.lit(level) * F.col("weight")
    filled = F.least(F.col("limit"), F.lit(level or 0.0) * F.col("weight"))
    return table.withColumn("target", filled).drop("limit")


def pivot(size: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Settles probabilities pair by pair, keeping the expected sum of size * p exactly; one at most is left between 0 and 1."""
    p, left, rng = p.copy(), -1, np.random.default_rng(seed)
    draws = rng.random(len(p))
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if left < 0:
            left = i
            continue
        a, b, sa, sb = p[left], p[i], float(size[left]), float(size[i])
        up = min((1.0 - a) * sa, b * sb)  # words that may move from i to left
        down = min(a * sa, (1.0 - b) * sb)  # and back
        moved = up if draws[i] * (up + down) < down else -down
        a, b = a + moved / sa, b - moved / sb
        a, b = (round(x) if abs(x - round(x)) < 1e-9 else x for x in (a, b))
        p[left], p[i] = a, b
        open_a, open_b = 0.0 < a < 1.0, 0.0 < b < 1.0
        left = left if open_a else i if open_b else -1
    return p


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds key: the row's name with a number, gapless from 0, among equal rows. They are numbered file by file (``_file``), so that no task holds all copies of one row."""
    before = Window.partitionBy("_h").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_h", "_file").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    counts = counts.withColumnsRenamed({"_h": "_ch", "_file": "_cf"})
    place = F.row_number().over(Window.partitionBy("_h", "_file").orderBy("size")) - 1
    numbered = rows.withColumn("_place", place).join(counts, (F.col("_h") == F.col("_ch")) & (F.col("_file") == F.col("_cf")))
    key = F.unhex(F.md5(F.concat(F.hex("_h"), F.lit(":"), (F.col("_start") + F.col("_place")).cast("string")).cast("binary")))
    return numbered.withColumn("key", key).drop("_file", "_place", "_start", "_ch", "_cf")


def settle(rows: DataFrame, last: bool) -> DataFrame:
    """One level of the tree: rows (block, key, size, p) with new p. Blocks are read one after the other in sorted partitions."""
    cols = ["block", "key", "size", "p"]

    def run(batches):
        held = {"block": None, "rows": []}

        def close():
            block, parts = held["block"], held["rows"]
            key = pa.concat_arrays([x[0] for x in parts])
            size = np.concatenate([x[1] for x in parts])
            p = np.concatenate([x[2] for x in parts])
            seed = xxhash.xxh64_intdigest(f"{block}")
            p = pivot(size, p, seed)
            if last:
                for i in np.flatnonzero((p > 0.0) & (p < 1.0)):
                    p[i] = float(np.random.default_rng(seed + 1).random() < p[i])
            return pa.RecordBatch.from_arrays([pa.array([block] * len(key), pa.string()), key, pa.array(size), pa.array(p)], names=cols)

        for batch in batches:
            block = batch.column(0).to_numpy(zero_copy_only=False)
            key = batch.column(1)
            size, p = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held["rows"] and held["block"] != block[a]:
                    yield close()
                    held["rows"] = []
                held["block"] = block[a]
                held["rows"].append((key[a:b], size[a:b], p[a:b]))
        if held["rows"]:
            yield close()

    dealt = rows.select(*cols).repartition("block").sortWithinPartitions("block", "size", "key")
    return dealt.mapInArrow(run, "block string, key binary, size long, p double")


def mix(docs: DataFrame, scratch: Scratch, *keep: str, text: str = "text", source: str = "source", share: float = 1.0, weights=WEIGHTS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """Rows (keep, size, source_size, target, copies), one for each row of ``docs``; ``keep`` holds the id first."""
    # 128 bits name a row's id and text; numbers tell equal ones apart.
    same = F.unhex(F.md5(F.to_json(F.struct(F.col(f"`{keep[0]}`").cast("string").alias("i"), F.md5(F.col(text).cast("binary")).alias("t"))).cast("binary")))
    base = packed(docs, keep, F.col(source).alias("_source"), word_count(text).alias("size"), same.alias("_h"))
    base = scratch.write(base, "base").withColumn("_file", F.input_file_name())
    sizes = scratch.write(base.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows")), "sizes")
    plan = scratch.write(targets(sizes, share, weights, most).withColumnRenamed("source", "_s"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = base.join(plan, F.col("_source").eqNullSafe(F.col("_s")), "left").withColumn("rate", rate)
    rows = rows.withColumn("sure", F.floor("rate").cast("long")).withColumn("p", F.col("rate") - F.col("sure"))
    rows = scratch.write(_keyed(rows), "rows")
    tag = F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("n"))
    todo = rows.where("p > 0 AND p < 1 AND size > 0").select(tag.alias("tag"), "key", "size", "p", F.ceil(F.col("source_rows") / block).alias("blocks"))
    todo = scratch.write(todo, "todo-0")
    done, level = [], 0
    while True:
        last = not todo.where("blocks > 1").limit(1).count()
        name = F.concat_ws(":", "tag", F.lit(level), F.pmod(F.xxhash64("key", F.lit(level)), F.col("blocks")))
        dealt = todo.withColumn("block", name)
        after = scratch.write(settle(dealt, last), f"level-{level}")
        done.append(after.where("p <= 0 OR p >= 1").select("key", "p"))
        if last:
            break
        level += 1
        left = after.where("p > 0 AND p < 1").select("key", "size", "p").join(todo.select("key", "tag", "blocks"), "key")
        todo = scratch.write(left.withColumn("blocks", F.ceil(F.col("blocks") / block)), f"todo-{level}")
    settled = done[0]
    for x in done[1:]:
        settled = settled.unionByName(x)
    settled = settled.select("key", F.col("p").alias("extra"))
    out = rows.join(settled, "key", "left")
    scratch.drop("base")
    out = out.withColumn("copies", (F.col("sure") + F.coalesce(F.col("extra"), F.lit(0.0))).cast("long"))
    return unpacked(out, keep, "size", "source_size", "target", "copies")


def op7_mixing(spark, sf_dir):
    found = mix(documents(spark, sf_dir), Scratch(spark, "op7"), "doc_id")
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op7_mixing": op7_mixing}
ORACLES: dict[str, str] = {}
