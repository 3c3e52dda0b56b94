"""Similar chunks by superfeatures and sketches, and deltas against them."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.cdc import delta_size, fingerprint
from siltstone.operators.report import delta_accepts
from siltstone.operators.segments import FLUSH_ROWS, PRINTS, print_columns

#: A bucket keeps so many of its smallest ids, a query so many of its nearest candidates.
BUCKET, CANDIDATES = 64, 16
#: More than any distance: a target's own id among a bucket's.
_SELF = 1 << 30


def fingerprints(chunks: DataFrame) -> DataFrame:
    """(object_id, chunk_id, length, features, sketch): features as 16 hex digits, which sort as unsigned words; sketch as signed words. Chunks that carry
    their fingerprints (``content_chunks``) keep them."""
    if "features" in chunks.columns:
        return chunks.where("features IS NOT NULL").select("object_id", "chunk_id", F.col("length").cast("long").alias("length"), "features", "sketch")
    kind = chunks.schema["object_id"].dataType.simpleString()
    schema = f"object_id {kind}, chunk_id string, length long, {PRINTS}"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, FLUSH_ROWS):
                part = batch.slice(at, FLUSH_ROWS)
                found = print_columns([fingerprint(x.as_py()) for x in part.column(3)])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *found], names=["object_id", "chunk_id", "length", "features", "sketch"])
        pa.default_memory_pool().release_unused()  # the worker lives on

    return chunks.where("octet_length(bytes) > 0").select("object_id", "chunk_id", F.col("length").cast("long"), "bytes").mapInArrow(run, schema)


def distance(a, b):
    """Differing bits of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def candidates(prints: DataFrame, bucket: int = BUCKET, most: int = CANDIDATES) -> DataFrame:
    """(object_id, chunk_id, candidate_id, distance, rank): nearest chunks of earlier objects with the same length and a superfeature in common.

    A bucket is a slot's superfeature with a length. It offers the ``bucket`` smallest ids that are earlier than the target's object. A bucket streams
    through one task in the order of objects, with its ``bucket`` + 1 smallest ids so far as the only state (one of them may be the target), so the work
    grows with its rows, not with their pairs. A target takes the ``most`` nearest from each bucket: none but these can be among its nearest of all.
    """
    kind = prints.schema["object_id"].dataType.simpleString()
    slots = prints.where("object_id IS NOT NULL").select("object_id", "chunk_id", "length", "sketch", F.posexplode("features").alias("slot", "feature"))
    key = ["slot", "length", "feature"]
    dealt = slots.select(*key, "object_id", "chunk_id", "sketch").repartition(*key).sortWithinPartitions(*key, "object_id", "chunk_id")

    def run(batches):
        offer = _Bucket(bucket, most)
        for batch in batches:
            yield offer.meet(batch)

    met = dealt.mapInArrow(run, f"object_id {kind}, chunk_id string, candidate_id string, distance int")
    # What two slots offer has one distance, hence one rank.
    rank = F.dense_rank().over(Window.partitionBy("object_id", "chunk_id").orderBy("distance", "candidate_id"))
    near = met.repartition("object_id", "chunk_id").withColumn("rank", rank).where(F.col("rank") <= most)
    return near.dropDuplicates(["object_id", "chunk_id", "candidate_id"]).select("object_id", "chunk_id", "candidate_id", "distance", "rank")


class _Bucket:
    """The smallest ids of the bucket that streams by, with their sketches."""

    def __init__(self, bucket: int, most: int):
        self.bucket, self.most = bucket, most
        self.ids, self.sketches, self.table, self.held = [], [], None, []
        self.last = None

    def _add(self, chunk: str, sketch) -> None:
        at = bisect_left(self.ids, chunk)
        self.ids.insert(at, chunk)
        self.sketches.insert(at, sketch)
        del self.ids[self.bucket + 1 :], self.sketches[self.bucket + 1 :]
        self.table = None

    def _wants(self, chunk: str) -> bool:
        if len(self.ids) > self.bucket and chunk > self.ids[-1]:
            return False
        at = bisect_left(self.ids, chunk)
        return at == len(self.ids) or self.ids[at] != chunk

    def _near(self, at: list[int], chunks: list[str], sketches: np.ndarray, out: list) -> None:
        """Adds (rows, ids, distances) of the nearest ids to the rows ``at``."""
        if not at or (len(self.ids) == 1 and all(chunks[i] == self.ids[0] for i in at)):
            return
        if self.table is None:
            self.table = np.array(self.sketches, np.uint64)
        places = {c: k for k, c in enumerate(self.ids)}
        for begin in range(0, len(at), 512):
            rows = np.array(at[begin : begin + 512])
            far = np.bitwise_count(sketches[rows][:, None, :] ^ self.table[None]).sum(axis=2, dtype=np.int32)
            for r, i in enumerate(rows):
                k = places.get(chunks[i], self.bucket)
                if k < len(self.ids):
                    far[r, k] = _SELF
            order = np.argsort(far, axis=1, kind="stable")[:, : self.most]
            dist = np.take_along_axis(far, order, axis=1)
            r, k = np.nonzero(dist < _SELF)
            out.append((rows[r], [self.ids[x] for x in order[r, k]], dist[r, k]))

    def meet(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        n, out = batch.num_rows, []
        keys = [np.concatenate([[False], pc.equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)]) if n else np.zeros(0, bool) for c in batch.columns[:5]]
        first = tuple(c[0].as_py() for c in batch.columns[:5]) if n else None
        goes_on = n and self.last is not None and first[:3] == self.last[:3]
        same = keys[0] & keys[1] & keys[2]
        fresh = ~(same & keys[3])  # the first row of an object in its bucket
        again = ~fresh & keys[4]
        if goes_on:
            same[0], fresh[0] = True, first[3] != self.last[3]
            again[0] = not fresh[0] and first[4] == self.last[4]
        starts = np.flatnonzero(~same)
        bounds = np.unique(np.concatenate([[0], starts, [n]])) if n else np.zeros(1, int)
        sizes = np.diff(bounds)
        # A bucket with one row has nothing to offer; the last one may go on in the next batch.
        groups = [g for g in np.flatnonzero(sizes > 1)]
        groups = sorted({*groups, *([0] if goes_on else []), *([len(sizes) - 1] if n else [])})
        chunks, sketches = batch.column(4), _words(batch.column(5))
        for g in groups:
            a, b = int(bounds[g]), int(bounds[g + 1])
            if not same[a]:
                self.ids, self.sketches, self.table, self.held = [], [], None, []
            own = dict(zip(range(a, b), chunks[a:b].to_pylist()))
            waiting = []
            for i in range(a, b):
                if fresh[i]:
                    for c, sketch in self.held:
                        if self._wants(c):
                            self._near(waiting, own, sketches, out)
                            waiting = []
                            self._add(c, sketch)
                    self.held = []
                elif again[i]:
                    continue
                if self.ids:
                    waiting.append(i)
                if len(self.held) <= self.bucket:
                    self.held.append((own[i], sketches[i].copy()))
            self._near(waiting, own, sketches, out)
        if n:
            self.last = tuple(c[n - 1].as_py() for c in batch.columns[:5])
        rows = pa.array(np.concatenate([x[0] for x in out]) if out else np.zeros(0, np.int64), pa.int64())
        ids = pa.array([c for x in out for c in x[1]], pa.string())
        dist = pa.array(np.concatenate([x[2] for x in out]) if out else np.zeros(0, np.int32), pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(3).take(rows), chunks.take(rows), ids, dist], names=["object_id", "chunk_id", "candidate_id", "distance"])


def _words(sketches) -> np.ndarray:
    """Sketches of one length as rows of unsigned words."""
    flat = sketches.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return flat.reshape(len(sketches), -1) if len(sketches) else flat.reshape(0, 1)


def index_faults(prints: DataFrame, postings: DataFrame) -> DataFrame:
    """(chunk_id, slot, feature, fault) of a feature index (slot, feature, length, chunk_id) against the fingerprints: MISSING postings, and EXTRA ones that no chunk asks
    for; must be empty."""
    key = ["slot", "feature", "length", "chunk_id"]
    want = prints.select("chunk_id", "length", "features").distinct().select("chunk_id", "length", F.posexplode("features").alias("slot", "feature"))
    both = want.select(*key, F.lit(1).alias("want"), F.lit(0).alias("have")).unionByName(postings.select(*key, F.lit(0).alias("want"), F.lit(1).alias("have")))
    sides = both.groupBy(*key).agg(F.max("want").alias("want"), F.max("have").alias("have")).where("want <> have")
    return sides.select("chunk_id", "slot", "feature", F.when(F.col("want") == 1, "MISSING").otherwise("EXTRA").alias("fault"))


def delta_trials(found: DataFrame, payload: DataFrame, trials: int = 4) -> DataFrame:
    """(object_id, chunk_id, base_id, cost, accepted): the cheapest delta of each chunk among its nearest candidates.

    payload: (chunk_id, bytes, independent_bytes), each chunk once.
    """
    target = payload.select("chunk_id", F.col("bytes").alias("target"), F.col("independent_bytes").cast("long").alias("independent_bytes"))
    base = payload.select(F.col("chunk_id").alias("candidate_id"), F.col("bytes").alias("base"))
    pairs = found.where(F.col("rank") <= trials).select("object_id", "chunk_id", "candidate_id", F.col("rank").cast("int").alias("rank")).join(target, "chunk_id").join(base, "candidate_id")
    kind = found.schema["object_id"].dataType.simpleString()
    names = ["object_id", "chunk_id", "base_id", "rank", "independent_bytes", "cost"]

    def run(batches):
        for batch in batches:
            costs = [delta_size(b.as_py(), t.as_py()) for b, t in zip(batch.column(6), batch.column(5))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(costs, pa.int64())], names=names)
        pa.default_memory_pool().release_unused()  # the worker lives on

    priced = pairs.select("object_id", "chunk_id", "candidate_id", "rank", "independent_bytes", "target", "base")
    costs = priced.mapInArrow(run, f"object_id {kind}, chunk_id string, base_id string, rank int, independent_bytes long, cost long")
    best = costs.groupBy("object_id", "chunk_id").agg(F.min(F.struct("cost", "rank", "base_id", "independent_bytes")).alias("b"))
    return best.select("object_id", "chunk_id", "b.base_id", "b.cost", delta_accepts(F.col("b.independent_bytes"), F.col("b.cost")).alias("accepted"))
