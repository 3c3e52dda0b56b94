"""Shards by balanced label propagation, with DataFrame functions only.

Documents of equal texts are linked. Labels (shards) start from a hash of the document's id. In each round every group of linked documents
that is not settled looks at its members' shards and proposes to move together to the one that holds most of them among those with room;
a shard accepts the largest proposals up to its quota. A group that fits none of
its members' shards proposes to any shard with room for it; rounds end when no group that is left fits a shard. Links run through the group, so a group costs one row for each shard in use and no
pair is ever formed. The law is ``rows``: at the end each shard holds n // k or n // k + 1 documents; unlinked ones move first.

Groups larger than an eighth of a shard, of which there are few, are placed before the others, the largest first, each whole in the shard that
it fills best. Only what no shard has room for is cut: it fills the roomiest shard and the rest is placed again, so a group of several
shards' size lies in as few of them as can be. Which rows of a cut group go where comes from their rank in it, so no task holds a hot
group. Ranks come from counts of hashed buckets (``common.ranked``). Only loads of the shards, k numbers, and sizes of the groups
over an eighth of a shard, 16 k at most, reach the driver.

Defined cases: a null text has no bytes (size 8, checksum 0) and no links; repeated rows are linked and each gets a slot; null ids are
allowed; of equal rows any may come first (ties); texts of any length cost a checksum; an empty table gives no rows; a kept column with the name of
one of the operator's own gives way to it.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, documents, packed, ranked, unpacked

SHARDS = 24
#: Classes of priority in which a shard accepts proposals.
BINS = 1024
_TYPES = {"g": pa.binary(), "begin": pa.int64(), "end": pa.int64(), "target": pa.int32()}


def place(sizes: list[int], room: list[int]) -> list[list[tuple[int, int]]]:
    """[(shard, rows)] for each size; ``room`` goes down by them."""
    found: list[list[tuple[int, int]]] = [[] for _ in sizes]
    todo = [(-n, i) for i, n in enumerate(sizes)]
    heapq.heapify(todo)
    while todo:
        n, i = heapq.heappop(todo)
        at = min((s for s, x in enumerate(room) if x >= -n), key=lambda s: room[s], default=None)
        if at is None:
            at = max(range(len(room)), key=lambda s: room[s])
        taken = min(-n, room[at])
        found[i].append((at, taken))
        room[at] -= taken
        if n + taken:
            heapq.heappush(todo, (n + taken, i))
    return found


def _starts(pieces: list[tuple[int, int]]) -> list[int]:
    return [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]


def _few(spark, rows: list[tuple], *names: str) -> DataFrame:
    """A table of few rows. Made from Arrow, it starts no Python workers."""
    columns = zip(*rows) if rows else [()] * len(names)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, _TYPES[n]) for n, c in zip(names, columns)], names=[*names]))


def propagate(cells: DataFrame, room: list[int], scratch: Scratch) -> DataFrame:
    """(g, target) for the groups that settle. cells: (g, shard, n), the members of a group by shard; room: rows that each shard still takes."""
    settled, i = None, 0
    while True:
        free = F.array(*[F.lit(x) for x in room])
        whole = F.sum("n").over(Window.partitionBy("g"))
        here = cells.withColumn("total", whole).withColumn("fits", F.col("total") <= F.element_at(free, F.col("shard") + 1))
        best = F.max_by("shard", F.struct(F.col("fits").cast("int"), "n", F.hash("g", "shard")))
        wishes = here.groupBy("g").agg(best.alias("target"), F.first("total").alias("total"), F.max("fits").alias("fits"))
        # A group that fits none of its members' shards turns to one of all shards with room for it; where there is none it stays.
        others = F.filter(F.sequence(F.lit(0), F.lit(len(room) - 1)), lambda s: F.element_at(free, s + 1) >= F.col("total"))
        wishes = wishes.withColumn("others", others).where("fits OR size(others) > 0")
        other = F.element_at("others", F.pmod(F.xxhash64("g", F.lit(i)), F.size("others")).cast("int") + 1)
        wishes = wishes.withColumn("target", F.when(F.col("fits"), F.col("target")).otherwise(other)).drop("fits", "others")
        size_class = F.greatest(F.lit(0), F.lit(63) - F.floor(F.log2("total"))).cast("int")
        wishes = wishes.withColumn("bin", size_class * (BINS // 64) + F.pmod(F.xxhash64("g"), F.lit(BINS // 64)))
        wishes = scratch.write(wishes, f"wishes-{i}")
        load = wishes.groupBy("target", "bin").agg(F.sum("total").alias("load"))
        before = Window.partitionBy("target").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        load = load.select("target", "bin", F.coalesce(F.sum("load").over(before), F.lit(0)).alias("before"))
        upto = F.sum("total").over(Window.partitionBy("target", "bin").orderBy(F.desc("total"), "g").rowsBetween(Window.unboundedPreceding, 0))
        upto = wishes.withColumn("upto", upto).join(F.broadcast(load), ["target", "bin"])  # k * BINS rows at most
        # The first proposal of a shard always fits, so each round with proposals settles groups.
        yes = upto.where(F.col("before") + F.col("upto") <= F.element_at(free, F.col("target") + 1))
        accepted = scratch.write(yes.select("g", "target", "total"), f"settled-{i}")
        settled = accepted if settled is None else settled.unionByName(accepted)
        more = {r.target: r.load for r in accepted.groupBy("target").agg(F.sum("total").alias("load")).collect()}  # k rows
        room = [x - more.get(s, 0) for s, x in enumerate(room)]
        scratch.drop(f"wishes-{i}")
        if not more:
            break
        cells = scratch.write(cells.join(accepted, "g", "left_anti"), f"cells-{i}")
        if cells.isEmpty():
            break
        i += 1
    return settled.select("g", "target")


def shard(docs: DataFrame, scratch: Scratch, *keep: str, text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Rows (keep, size, text_crc32, shard, slot), one for each row of ``docs``; ``keep`` holds the id first."""
    t = F.col(text)
    ident = F.col(f"`{keep[0]}`")
    base = packed(
        docs,
        keep,
        ident.alias("id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(t.cast("binary"))).alias("g"),
        F.xxhash64(ident).alias("h"),
    )
    base = scratch.write(base, "base")
    rows = base.count()
    want = [rows // shards + (s < rows % shards) for s in range(shards)]
    linked = base.where("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("copies")).where("copies > 1")
    linked = scratch.write(linked, "linked")
    large = F.col("copies") * 8 > max(1, rows // shards)
    few = sorted((bytes(r.g), r.copies) for r in linked.where(large).collect())  # 16 for each shard at most
    room = list(want)
    placed = place([n for _, n in few], room)
    whole = [(g, p[0][0]) for (g, _), p in zip(few, placed) if len(p) == 1]
    cut = [(g, r, r + n, s) for (g, _), p in zip(few, placed) if len(p) > 1 for r, (s, n) in zip(_starts(p), p)]
    base = base.withColumn("shard0", F.pmod("h", F.lit(shards)).cast("int"))
    spark = docs.sparkSession
    known = F.broadcast(_few(spark, [(g,) for g, _ in few], "g"))
    cells = base.join(known, "g", "left_anti").join(linked.where(~large), "g").groupBy("g", F.col("shard0").alias("shard")).agg(F.count("*").alias("n"))
    settled = propagate(scratch.write(cells, "cells"), room, scratch)
    columns = ["_keep", "id", "size", "text_crc32", "g", "shard0"]
    cuts = F.broadcast(_few(spark, cut, "g", "begin", "end", "target"))  # 17 rows for each shard at most
    heads = F.broadcast(_few(spark, [(g,) for g in {c[0] for c in cut}], "g"))
    at_home = base.join(known, "g", "left_anti").join(settled, "g", "left").select(*columns, "target")
    at_home = at_home.unionByName(base.join(F.broadcast(_few(spark, whole, "g", "target")), "g").select(*columns, "target"))
    order = ["id", "size", "text_crc32"]
    parts = ranked(base.join(heads, "g", "left_semi").select(*columns), "g", None, order, rows, "r", bucket_rows=max(1, min(20000, rows // shards // 64)))
    parts = parts.join(cuts.withColumnRenamed("g", "_g"), (F.col("g") == F.col("_g")) & (F.col("r") >= F.col("begin")) & (F.col("r") < F.col("end"))).select(*columns, "target")
    placed = at_home.unionByName(parts) if cut else at_home
    placed = placed.withColumn("at", F.coalesce("target", "shard0")).withColumn("is_linked", F.col("target").isNotNull()).select("_keep", "id", "size", "text_crc32", "g", "at", "is_linked")
    placed = scratch.write(ranked(scratch.write(placed, "placed"), "at", "is_linked", ["id", "size", "text_crc32", "g"], rows // shards, "r"), "ranked")
    scratch.drop("placed", "base", "linked")
    have = {r["at"]: r.n for r in placed.groupBy("at").agg(F.count("*").alias("n")).collect()}  # one row for each shard
    have = [have.get(s, 0) for s in range(shards)]
    # Rows beyond a shard's share get a common rank and fill the other shards' gaps in turn.
    over, gaps = [0], [0]
    for h, w in zip(have, want):
        over.append(over[-1] + max(0, h - w))
        gaps.append(gaps[-1] + max(0, w - h))
    numbers = lambda xs: F.array(*[F.lit(x) for x in xs])
    pick = lambda xs, i: F.element_at(numbers(xs), i + 1)
    rank, at = F.col("r"), F.col("at")
    stays = rank < pick(want, at)
    common = rank - pick(want, at) + pick(over[:-1], at)
    placed = placed.withColumn("common", F.when(~stays, common))
    placed = placed.withColumn("to", F.when(stays, at).otherwise(F.size(F.filter(numbers(gaps[1:]), lambda x: x <= F.col("common")))))
    slot = F.when(stays, rank).otherwise(F.col("common") - pick(gaps[:-1], F.col("to")) + pick(have, F.col("to")))
    placed = placed.select("_keep", "size", "text_crc32", F.col("to").cast("int").alias("shard"), slot.cast("long").alias("slot"))
    return unpacked(placed, keep, "size", "text_crc32", "shard", "slot")


def op3_sharding(spark, sf_dir):
    found = shard(documents(spark, sf_dir), Scratch(spark, "op3"), "doc_id")
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op3_sharding": op3_sharding}
ORACLES: dict[str, str] = {}
