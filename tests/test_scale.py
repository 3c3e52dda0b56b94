"""Steps that must stay bounded as tables grow, and results that must not depend on how they are bounded."""

import hashlib
import random
import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import cdc
from siltstone.operators import index, maintenance, reduction, replay, segments, similarity
from siltstone.plans import derive, rule_queries
from siltstone.policy import Policy


def test_gate_regions_are_bounded(spark, tmp_path, monkeypatch):
    """A source over the bound is dealt over several regions without losing a text; the noise's seed is the length of all its texts, joined."""
    rows = [(i, "big" if i % 3 else None, f"text {i} of a source " * 20) for i in range(90)] + [(90, "one", "x"), (91, "none", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    whole = {r.region: bytes(r.bytes) for r in rule_queries.gate_regions(spark, str(tmp_path)).where("region NOT LIKE 'small-%'").collect()}
    texts = {s: sorted(t for _, x, t in rows if x == s and t) for s in ("big", None, "one", "none")}
    for source, found in texts.items():
        joined, name = "\n".join(found), source or ""
        assert whole.get(f"text-{name}", b"").decode() == joined
        assert whole[f"noise-{name}"] == b"".join(hashlib.sha256(":".join([str(len(joined)), *([source] if source else []), str(i)]).encode()).digest() for i in range(5000))
    monkeypatch.setattr(rule_queries, "SOURCE_BYTES", 4000)
    cut = rule_queries.gate_regions(spark, str(tmp_path)).where("region LIKE 'text-%'").collect()
    assert sorted(t for r in cut for t in bytes(r.bytes).decode().split("\n")) == sorted(t for x in texts.values() for t in x)
    assert max(len(r.bytes) for r in cut) < len("\n".join(texts["big"])) / 2 and {r.region for r in cut} == {"text-big", "text-", "text-one"}


def test_candidates_of_a_hot_bucket(spark):
    """A bucket offers its smallest ids, each once, whatever its size and however often an object holds a chunk."""
    rng = random.Random(5)
    rows = []
    for o in range(300):
        for _ in range(rng.randint(1, 3)):
            c = rng.randrange(200)
            rows += [(o, f"{c * 7919 % 1000:03d}", 100 + c % 2, [f"f{c % 3}", f"g{c % 5}"], [rng_word(c, k) for k in range(8)])] * rng.randint(1, 2)
    rng.shuffle(rows)
    prints = spark.createDataFrame(rows, "object_id long, chunk_id string, length long, features array<string>, sketch array<long>")
    buckets, first, sketch, want = {}, {}, {}, {}
    for o, c, n, features, s in rows:
        sketch[c] = s
        first[c] = min(o, first.get(c, o))
        for slot, f in enumerate(features):
            buckets.setdefault((slot, n, f), set()).add(c)
    for o, c, n, features, s in rows:
        near = set()
        for slot, f in enumerate(features):
            near |= set(sorted(x for x in buckets[slot, n, f] if first[x] < o and x != c)[:5])
        far = {x: sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(s, sketch[x])) for x in near}
        want[o, c] = [(x, far[x], k + 1) for k, x in enumerate(sorted(near, key=lambda x: (far[x], x))[:3])]
    got = {k: [] for k in want}
    for r in similarity.candidates(prints, 5, 3).orderBy("rank").collect():
        got[r.object_id, r.chunk_id].append((r.candidate_id, r.distance, r["rank"]))
    assert got == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        again = similarity.candidates(prints.repartition(3), 5, 3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(again) == sum(map(len, want.values())) and all((r.candidate_id, r.distance, r["rank"]) in want[r.object_id, r.chunk_id] for r in again)
    plan = similarity.candidates(prints)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # no pairs of a bucket's rows


def rng_word(c, k):
    return int.from_bytes(hashlib.sha256(f"{c}:{k}".encode()).digest()[:8], "big", signed=True)


@given(st.binary(max_size=60), st.lists(st.tuples(st.integers(0, 59), st.integers(0, 255)), max_size=30))
def test_delta_size(base, changes):
    target = bytearray(base)
    for at, x in changes:
        if at < len(target):
            target[at] = x
    assert cdc.delta_size(base, bytes(target)) == cdc.delta_cost(cdc.delta_runs(base, bytes(target)))


def test_workers_hand_on_small_batches(spark, monkeypatch):
    """A worker holds what it makes from a bounded number of bytes, and prints made beside the chunks are those of their bytes."""
    import pyarrow as pa

    rng = random.Random(7)
    rows = [(i, rng.randbytes(3000)) for i in range(3000)] + [(5000, b""), (5001, None), (5002, b"a" * 4000)]
    batch = pa.RecordBatch.from_pydict({"object_id": pa.array([r[0] for r in rows], pa.int64()), "bytes": pa.array([r[1] for r in rows], pa.binary())})
    objects = spark.createDataFrame(rows, "object_id long, bytes binary")
    profile = cdc.CdcProfile(3, 30, 64, 256, 4096)
    kept = []
    monkeypatch.setattr(type(objects), "mapInArrow", lambda self, run, schema: kept.append(run) or self)
    segments.content_chunks(objects.select("object_id", "bytes"), profile, 512)
    made = list(kept[0]([batch]))
    monkeypatch.undo()
    assert max(b.num_rows for b in made) < 2 * segments.FLUSH_ROWS and max(b.nbytes for b in made) < 2 * segments.FLUSH_BYTES and len(made) < 50
    assert b"".join(x.as_py() or b"" for b in made for x in b.column("bytes")) == b"".join(x or b"" for i, x in rows if i != 5002)
    some = objects.where("object_id % 100 = 2")
    beside = similarity.fingerprints(segments.content_chunks(some, profile, 512, with_bytes=False, prints=True))
    apart = similarity.fingerprints(segments.content_chunks(some, profile, 512).where("kind = 'DATA'"))
    assert beside.count() == apart.count() > 0 and beside.exceptAll(apart).isEmpty()


def test_byte_ranges(spark):
    objects = spark.createDataFrame([(1, b"abcdef"), (2, b"ghij"), (3, b"klm")], "object_id long, bytes binary")
    ranges = spark.createDataFrame([(1, 0, 2, "x"), (1, 4, 2, "y"), (3, 1, 1, "z")], "object_id long, input_offset long, raw_bytes long, name string")
    assert {r.name: bytes(r.bytes) for r in segments.byte_ranges(objects, ranges).collect()} == {"x": b"ab", "y": b"ef", "z": b"l"}


def test_reduction_keeps_no_payload(spark):
    """What a reduction keeps between its steps has no bytes of objects, and each object's bytes move once for its regions."""
    rng = random.Random(3)
    base = rng.randbytes(60000)
    objects = spark.createDataFrame([(0, base), (1, base[:30000] + b"x" + base[30001:]), (2, b"abc" * 9000)], "object_id long, bytes binary")
    done = reduction.reduce(objects, Policy.preset("all", profile=cdc.CdcProfile(6, 50, 256, 8192, 16384)))
    plan = done.report()._jdf.queryExecution().optimizedPlan().toString()
    kept = re.findall(r"InMemoryRelation \[(.*?)\]", plan)
    assert kept and not any(re.search(r"\bbytes#|\bpayload#", x) for x in kept)
    alone = reduction.reduce(objects, Policy.preset("delta", profile=done.policy.profile))
    assert [(r.object_id, r.cost) for r in alone.deltas.where("accepted").collect()] == [(1, 36 + 9)]
    assert {r.object_id: bytes(r.bytes) for r in done.restore().collect()} == {r.object_id: bytes(r.bytes) for r in objects.collect()}


def test_batches_are_packed_side_by_side(spark):
    """Containers go on from the state that those before them leave; only lengths pass through one task."""
    rng = random.Random(11)
    rows = [(f"c{rng.randrange(40)}", rng.randrange(1000), f"k{i}", rng.choice([10, 400, 900, 1500])) for i in range(3000)]
    copies = spark.createDataFrame(rows, "container_id string, chunk_ordinal long, chunk_id string, logical_length long")
    want, batch, place, size = [], 0, 0, 0
    for row in sorted(rows):
        if place and (size + row[3] > 5000 or place >= 7):
            batch, place, size = batch + 1, 0, 0
        want.append((*row, batch, place))
        place, size = place + 1, size + row[3]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        packed = maintenance.replacement_batches(copies.repartition(5), 5000, 7)
        assert sorted(map(tuple, packed.collect())) == sorted(want)
        assert packed.groupBy(F.spark_partition_id()).count().count() > 1
        assert maintenance.replacement_batches(copies.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_approximate_distinct_keeps_one_sketch_a_type(spark, tmp_path):
    rows = [(i, i % 50, None if i % 3 == 0 else "view") for i in range(600)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = rule_queries.QUERIES["approximate_distinct"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == [("view", 50, True), (None, 50, True)]
    for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n"):
        assert "approx_count_distinct" not in line or "user_id" not in line.split("[")[1].split("]")[0]  # no sketch for each user


def test_runs_get_more_ranges_with_more_entries(spark, monkeypatch):
    entries = spark.range(4000).selectExpr("md5(CAST(id % 900 AS STRING)) AS chunk_id", "id AS logical_length", "'c' AS container_id", "id AS record_offset", "id AS chunk_ordinal")
    assert index.run_sorted(entries, 4).rdd.getNumPartitions() == 4
    monkeypatch.setattr(index, "PARTITION_ENTRIES", 100)
    parts = index.run_sorted(entries, 4).rdd.map(lambda r: r.chunk_id).glom().collect()
    assert len(parts) == 40 and max(map(len, parts)) < 400 and all(p == sorted(p) for p in parts)
    assert sum(len(set(p)) for p in parts) == 900 and sum(map(len, parts)) == 4000


def test_index_faults_need_no_join(spark):
    prints = spark.createDataFrame([("a", 1, ["x", "y"]), ("a", 1, ["x", "y"]), ("b", None, ["z"])], "chunk_id string, length long, features array<string>")
    postings = spark.createDataFrame([(0, "x", 1, "a"), (0, "x", 1, "a"), (2, "y", 1, "a")], "slot int, feature string, length long, chunk_id string")
    got = similarity.index_faults(prints, postings)
    assert sorted(map(tuple, got.collect())) == [("a", 1, "y", "MISSING"), ("a", 2, "y", "EXTRA"), ("b", 0, "z", "MISSING")]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_replay_of_packed_blocks(spark, monkeypatch):
    """The trace reaches a replay whole and in order, in blocks: its task sorts no events."""
    rng = random.Random(2)
    events = [(s, rng.choice(["PUBLISHED", "LOOKUP", "EXACT_REUSE"]), rng.randrange(60), rng.randrange(1000)) for s in range(5000)]
    trace = spark.createDataFrame(rng.sample(events, len(events)), "seq long, kind string, key long, verify_bytes long")
    monkeypatch.setattr(replay, "BLOCK_ROWS", 64)
    got = {(r.policy, r.budget): r for r in replay.replay(trace, ["s3fifo", "sieve"], [1920, 5760]).collect()}
    assert len(got) == 4
    for (policy, budget), r in got.items():
        assert {c: r[c] for c in replay.COUNTS} == replay.replay_events([e[1:] for e in events], policy, budget)
    plan = replay.replay(trace, ["sieve"], [1920])._jdf.queryExecution().optimizedPlan().toString()
    assert not any("verify_bytes" in x for x in plan.split("\n") if "policy ASC" in x or "policy#" in x and "Sort" in x) and plan.count("MapInArrow") == 2
    assert replay.replay(trace.limit(0), ["sieve"], [1920]).count() == 0


def test_larger_tables_are_dealt_to_more_partitions(spark, monkeypatch):
    """What a window of the extents sorts in one task is bounded by the table's size in all, not by the session's number of partitions."""
    folder = "/root/testdata/sf0.001"
    few = {tuple(r) for r in derive.extents(spark, folder).collect()}
    monkeypatch.setattr(derive, "DEAL_BYTES", 4096)
    many = derive.extents(spark, folder)
    assert many.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    assert {tuple(r) for r in many.collect()} == few
    sizes = [len(x) for x in many.rdd.glom().collect()]
    assert max(sizes) < sum(sizes) / 8


def test_rewrite_passes_once_over_the_extents(spark):
    plan = rule_queries.QUERIES["splice_range"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 3  # the extents, and the ends of the files for either side
