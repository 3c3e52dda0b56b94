"""The reduction of a collection of objects under a policy: chunk, find owners, group, encode, delta, reorder, report, restore, audit.

Objects come in the order of object_id. Payload bytes are read where they are cut and joined once with the narrow decisions. Decisions do
not depend on the number of partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import chunking, encoding, packing, segments, similarity
from siltstone.operators.report import MIN_SAVING
from siltstone.policy import Policy

#: Bytes of a delta without a run.
LEAST_DELTA = 36


@dataclass
class Reduction:
    """Tables of a reduction: chunks (recipes), regions with payloads, deltas, and the regions again without payloads, encoded once."""

    policy: Policy
    chunks: DataFrame
    regions: DataFrame
    deltas: DataFrame | None
    sizes: DataFrame

    def report(self) -> DataFrame:
        """One row for each object with the counts of its chunks, regions and deltas."""
        c = self.chunks
        hit = F.col("exact_hit")
        own = c.groupBy("object_id").agg(
            F.sum("length").alias("logical_bytes"),
            F.count_if(F.col("kind") == "DATA").alias("chunks"),
            F.count_if(F.col("kind") == "FILL").alias("fills"),
            F.sum(F.when(F.col("kind") == "FILL", F.col("length")).otherwise(0)).alias("fill_bytes"),
            F.count_if(hit).alias("exact_hits"),
            F.sum(F.when(hit, F.col("length")).otherwise(0)).alias("exact_hit_bytes"),
        )
        regions = self.sizes.groupBy("object_id").agg(
            F.count("*").alias("regions"),
            F.count_if(F.col("encoding") == "ZSTD").alias("zstd_regions"),
            F.sum("payload_bytes").alias("payload_bytes"),
            F.count_if("reordered").alias("reordered_regions"),
        )
        out = own.join(regions, "object_id", "left")
        if self.deltas is not None:
            d = self.deltas.groupBy("object_id").agg(F.count_if("accepted").alias("delta_chunks"), F.sum(F.when(F.col("accepted"), F.col("saved")).otherwise(0)).alias("delta_saved"))
            out = out.join(d, "object_id", "left")
        else:
            out = out.withColumn("delta_chunks", F.lit(0)).withColumn("delta_saved", F.lit(0))
        zero = {k: F.coalesce(k, F.lit(0)).cast("long") for k in ("regions", "zstd_regions", "payload_bytes", "reordered_regions", "delta_chunks", "delta_saved")}
        out = out.withColumns(zero)
        return out.withColumn("payload_bytes", F.col("payload_bytes") - F.col("delta_saved")).drop("delta_saved")

    def restore(self) -> DataFrame:
        """(object_id, bytes): objects from their recipes and decoded regions."""
        decoded = encoding.decode(self.regions.select("object_id", "region", "encoding", "payload", "raw_bytes"))
        owners = self.chunks.where("kind = 'DATA' AND NOT exact_hit")
        at = F.coalesce(F.sum("length").over(Window.partitionBy("object_id", "region").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = owners.select("object_id", "region", "ordinal", "chunk_id", "length").withColumn("at", at)
        cut = F.substring(F.col("bytes"), (F.col("at") + 1).cast("int"), F.col("length").cast("int"))
        payload = placed.join(decoded.select("object_id", "region", "bytes"), ["object_id", "region"]).select(F.col("object_id").alias("owner_object"), F.col("ordinal").alias("owner_ordinal"), cut.alias("part"))
        data = self.chunks.join(payload, ["owner_object", "owner_ordinal"], "left")
        fill = F.expr("unhex(repeat(lpad(hex(fill_value), 2, '0'), int(length)))")
        part = F.when(F.col("kind") == "FILL", fill).otherwise(F.col("part"))
        joined = data.select("object_id", F.struct("ordinal", F.hex(part).alias("h")).alias("p")).groupBy("object_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
        return joined.select("object_id", F.unhex(F.array_join(F.transform("p", lambda x: x.h), "")).alias("bytes"))


def reduce(objects: DataFrame, policy: Policy) -> Reduction:
    """Reduces rows (object_id, bytes).

    Chunks are cut without their bytes and kept; regions and the bases of deltas are cut from the objects once it is known where they lie.
    """
    prints = deltas = None
    similar = policy.has("similarity") or policy.has("reorder")
    if policy.has("cdc"):
        chunks = segments.content_chunks(objects, policy.profile, policy.fill_bytes, with_bytes=False, prints=similar)
    else:
        fixed = chunking.with_chunk_id(chunking.fixed_chunks(objects, policy.fixed_bytes))
        chunks = fixed.select("object_id", "ordinal", F.col("input_offset").cast("long").alias("input_offset"), F.col("length").cast("long").alias("length"), F.lit("DATA").alias("kind"), F.lit(None).cast("int").alias("fill_value"), "chunk_id")
        if similar:
            prints = similarity.fingerprints(fixed)
    chunks = chunks.cache()
    narrow = chunks.drop("features", "sketch")
    place = F.struct("object_id", "ordinal")
    if policy.has("exact"):
        first = narrow.where("kind = 'DATA'").groupBy("chunk_id", "length").agg(F.min(place).alias("owner"))
        marked = narrow.join(first, ["chunk_id", "length"], "left")
    else:
        marked = narrow.withColumn("owner", F.when(F.col("kind") == "DATA", place))
    marked = marked.withColumn("exact_hit", F.coalesce(F.col("owner") != place, F.lit(False)))
    marked = marked.select("*", F.col("owner.object_id").alias("owner_object"), F.col("owner.ordinal").alias("owner_ordinal")).drop("owner")
    # New chunks go into regions: a hit, a fill, a gap or a window's end breaks one; without grouping every chunk is a region.
    new = marked.where("kind = 'DATA' AND NOT exact_hit")
    by = Window.partitionBy("object_id").orderBy("ordinal")
    window = F.floor(F.col("input_offset") / policy.window_bytes)
    gap = F.coalesce((F.lag(F.col("input_offset") + F.col("length")).over(by) != F.col("input_offset")) | (F.lag(window).over(by) != window), F.lit(False))
    most = min(policy.region_bytes, policy.inflight_bytes) if policy.has("grouping") else 0
    rows = new.select("object_id", "ordinal", "length", "chunk_id", "input_offset", gap.alias("gap"))
    placed = packing.pack(rows, "object_id", ["ordinal"], "length", most, breaks="gap", name="region").drop("gap").cache()
    recipe = marked.join(placed.select("object_id", "ordinal", "region"), ["object_id", "ordinal"], "left")
    # A region's chunks follow each other in their object without a gap.
    spans = placed.groupBy("object_id", "region").agg(F.min("input_offset").alias("input_offset"), F.count("*").alias("chunks"), F.sum("length").cast("int").alias("raw_bytes"))
    raw = segments.byte_ranges(objects, spans)
    if policy.has("compression"):
        regions = encoding.encode(raw)
    else:
        regions = raw.withColumn("encoding", F.lit("RAW")).withColumn("payload_bytes", F.col("raw_bytes").cast("long")).withColumn("payload", F.col("bytes"))
    regions = regions.drop("bytes")
    sizes = regions.drop("payload").cache()
    if similar and prints is None:
        prints = similarity.fingerprints(chunks)
    if similar:
        prints = prints.join(placed.select("object_id", "chunk_id"), ["object_id", "chunk_id"], "left_semi")
    if policy.has("delta"):
        single = sizes.where("chunks = 1").select("object_id", "region", "payload_bytes").join(placed, ["object_id", "region"])
        alone = single.groupBy("chunk_id").agg(F.min("payload_bytes").alias("independent_bytes"), F.min(F.struct("object_id", "input_offset", F.col("length").alias("raw_bytes"))).alias("at")).cache()
        # A chunk whose payload is smaller than a delta's least saving and cost is not tried, as no delta of it could be accepted; candidates have its length.
        least = MIN_SAVING + LEAST_DELTA
        worth = alone.where(F.col("independent_bytes") >= least).select("chunk_id")
        found = similarity.candidates(prints.where(F.col("length") >= least), most=policy.candidates).where(F.col("rank") <= policy.trials).join(worth, "chunk_id", "left_semi")
        found = found.join(alone.select(F.col("chunk_id").alias("candidate_id")), "candidate_id", "left_semi").cache()
        asked = found.select("chunk_id").union(found.select("candidate_id")).distinct()
        payload = segments.byte_ranges(objects, alone.join(asked, "chunk_id", "left_semi").select("at.*", "chunk_id", "independent_bytes"))
        tried = similarity.delta_trials(found, payload, policy.trials)
        tried = tried.join(alone.select("chunk_id", "independent_bytes"), "chunk_id").withColumn("saved", F.col("independent_bytes") - F.col("cost"))
        # Depth one: a chunk that is itself an accepted delta is no base for another.
        itself = tried.where("accepted").select(F.col("chunk_id").alias("base_id")).distinct().withColumn("is_delta", F.lit(True))
        deltas = tried.join(itself, "base_id", "left").withColumn("accepted", F.col("accepted") & F.col("is_delta").isNull()).drop("is_delta")
    if policy.has("reorder"):
        first = placed.groupBy("object_id", "region").agg(F.min(F.struct("ordinal", "chunk_id", "input_offset")).alias("f")).select("object_id", "region", "f.*")
        keys = first.join(prints.dropDuplicates(["object_id", "chunk_id"]).select("object_id", "chunk_id", "features", "sketch"), ["object_id", "chunk_id"])
        order = Window.partitionBy("object_id").orderBy(F.floor(F.col("input_offset") / policy.window_bytes), "features", F.transform("sketch", lambda x: F.lpad(F.hex(x), 16, "0")), "region")
        ranked = keys.withColumn("place", F.row_number().over(order) - 1).select("object_id", "region", "place")
        regions, sizes = (x.join(ranked, ["object_id", "region"]).withColumn("reordered", F.col("place") != F.col("region")) for x in (regions, sizes))
    else:
        regions, sizes = (x.withColumn("place", F.col("region")).withColumn("reordered", F.lit(False)) for x in (regions, sizes))
    return Reduction(policy, recipe, regions, deltas, sizes)


def audit(reduction: Reduction) -> DataFrame:
    """(invariant, violations): each must be 0."""
    c, r = reduction.chunks, reduction.regions
    by = Window.partitionBy("object_id").orderBy("ordinal")
    gaps = c.withColumn("p", F.coalesce(F.lag(F.col("input_offset") + F.col("length")).over(by), F.lit(0))).where("p != input_offset")
    lost = c.where("exact_hit").join(c.where("kind = 'DATA' AND NOT exact_hit").select(F.col("object_id").alias("owner_object"), F.col("ordinal").alias("owner_ordinal"), F.col("chunk_id").alias("own")), ["owner_object", "owner_ordinal"], "left").where("own IS NULL OR own != chunk_id")
    sizes = c.where("region IS NOT NULL").groupBy("object_id", "region").agg(F.sum("length").alias("n")).join(r, ["object_id", "region"], "full_outer").where("n IS NULL OR raw_bytes IS NULL OR n != raw_bytes")
    conflicts = c.where("kind = 'DATA'").groupBy("chunk_id").agg(F.countDistinct("length").alias("k")).where("k > 1")
    count = lambda df, name: df.agg(F.lit(name).alias("invariant"), F.count("*").alias("violations"))
    return count(gaps, "recipes are gapless").union(count(lost, "hits have owners")).union(count(sizes, "regions hold their chunks")).union(count(conflicts, "ids have one length"))
