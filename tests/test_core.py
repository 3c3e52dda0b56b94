"""The engine against plain versions, and every query with SQL against DuckDB."""

import hashlib
import os
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import cdc
from siltstone.operators import dedup, encoding, files, generations, index, intervals, maintenance, packing, reduction, replay, report, segments, similarity
from siltstone.plans import registry
from siltstone.policy import PRESETS, Policy
from siltstone.sources import store
from siltstone.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = cdc.CdcProfile(3, 20, 40, 64, 1024)


def scalar_cuts(raw, p):
    out, base = [], 0
    while base < len(raw):
        n = len(raw) - base
        end, size = base + n, min(n, p.most)
        if n >= p.least:
            at, falls, rises, end = p.least, 0, 0, base + size
            while at < size:
                a, b = raw[base + at - 1], raw[base + at]
                if b < a:
                    falls, rises = falls + 1, 0
                elif b > a:
                    rises += 1
                if rises == p.sequence and b > a:
                    end = base + at
                    break
                at += 1
                if falls == p.skip_trigger:
                    at, falls = at + p.skip_bytes, 0
        out.append(end)
        base = end
    return out


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 6), st.integers(1, 12), st.integers(1, 60), st.integers(1, 50), st.integers(0, 300))
def test_cuts(raw, sequence, trigger, skip, least, more):
    p = cdc.CdcProfile(sequence, trigger, skip, least, least + more)
    assert cdc.cuts(raw, p, slab=100) == scalar_cuts(raw, p)


def test_cuts_resync_after_insertion():
    raw = np.random.default_rng(1).integers(0, 256, 1 << 22, dtype=np.uint8).tobytes()
    changed = raw[:1_234_567] + b"\xa7" + raw[1_234_567:]
    def ids(x):
        ends = [0, *cdc.cuts(x)]
        sizes = [b - a for a, b in zip(ends, ends[1:])]
        assert all(n >= 16384 for n in sizes[:-1]) and max(sizes) <= 262144
        return {hashlib.sha256(x[a:b]).digest(): b - a for a, b in zip(ends, ends[1:])}
    a, b = ids(raw), ids(changed)
    assert len(a) > 16 and sum(n for k, n in b.items() if k in a) >= 3 << 20


@pytest.mark.parametrize("n, fills", [(65535, 0), (65536, 1), (65537, 1)])
def test_fill_threshold(n, fills):
    assert sum(k == "FILL" for k, *_ in cdc.segments(bytes(n))) == fills


def test_adjacent_fills():
    assert cdc.segments(bytes(65536) + b"\xff" * 65536) == [("FILL", 0, 65536, 0), ("FILL", 65536, 131072, 255)]
    found = cdc.segments(os.urandom(24576) + b"\x11" * 65536 + os.urandom(24576))
    assert [x for x in found if x[0] == "FILL"] == [("FILL", 24576, 24576 + 65536, 17)]


def scalar_fingerprint(raw):
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    turn = lambda x, k: ((x << k) | (x >> (64 - k))) & mask if k else x
    h = [mix(cdc.BYTE_SEED ^ b) for b in raw]
    width = min(32, len(h))
    shingles = []
    for i in range(len(h) - width + 1):
        s = 0
        for k in range(width):
            s ^= turn(h[i + k], width - 1 - k)
        shingles.append(s)
    least = [min(shingles[i : i + 64]) for i in range(0, len(shingles), 64)]
    sketch = [sum(1 << b for b in range(64) if sum((mix(m ^ s) >> b) & 1 for m in least) * 2 > len(least)) for s in cdc.SKETCH_SEEDS]
    return [min(mix(m ^ s) for m in least) for s in cdc.FEATURE_SEEDS], sketch


@settings(max_examples=25, deadline=None)
@given(st.binary(min_size=1, max_size=700))
def test_fingerprint(raw):
    f, s = cdc.fingerprint(raw)
    assert (f.tolist(), s.tolist()) == scalar_fingerprint(raw)


def test_fingerprint_of_local_edit():
    raw = bytearray(np.random.default_rng(3).integers(0, 256, 65536, dtype=np.uint8).tobytes())
    other = bytearray(raw)
    other[32768] ^= 0x5A
    bits = lambda a, b: sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(a, b))
    a, b, c = (cdc.fingerprint(bytes(x))[1] for x in (raw, other, np.random.default_rng(4).integers(0, 256, 65536, dtype=np.uint8).tobytes()))
    assert bits(a, b) <= 32 < bits(a, c)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300), st.lists(st.tuples(st.integers(0, 299), st.integers(1, 255)), max_size=20))
def test_delta_round_trip(base, edits):
    target = bytearray(base)
    for at, x in edits:
        target[at % len(base)] ^= x
    runs = cdc.delta_runs(base, bytes(target))
    assert cdc.delta_apply(base, runs) == bytes(target)
    assert cdc.delta_cost(runs) == 36 + sum(8 + len(x) for _, x in runs)


def test_delta_rejects_bad_runs():
    for runs in ([(0, b"\x00")], [(2, b"\x01"), (1, b"\x01")], [(0, b"\x01"), (1, b"\x01")], [(9, b"\x01\x02")]):
        with pytest.raises(ValueError):
            cdc.delta_apply(bytes(10), runs)


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(9)
    noise = lambda n: rng.integers(0, 256, n, dtype=np.uint8).tobytes()
    base = noise(20000) + b'{"key": 1, "value": "text"}\n' * 900 + bytes(9000) + noise(20000)
    changed = bytearray(base)
    for at in range(4000, 60000, 9000):
        changed[at] ^= 0x5A
    rows = [(0, base), (1, bytes(changed)), (2, bytes(changed)), (3, b""), (4, b"x")]
    return spark.createDataFrame(rows, "object_id long, bytes binary").cache()


@pytest.mark.parametrize("preset", PRESETS)
def test_restore_and_audit(mixed, preset):
    profile = cdc.CdcProfile(6, 50, 256, 1024, 16384)
    done = reduction.reduce(mixed, Policy.preset(preset, profile=profile, fill_bytes=4096))
    want = {r.object_id: bytes(r.bytes) for r in mixed.collect() if r.bytes}
    assert {r.object_id: bytes(r.bytes) for r in done.restore().collect()} == want
    assert all(r.violations == 0 for r in reduction.audit(done).collect())
    rep = {r.object_id: r for r in done.report().collect()}
    assert {k: r.logical_bytes for k, r in rep.items()} == {k: len(v) for k, v in want.items()}
    if preset in ("exact", "delta", "similarity", "all"):
        assert rep[2].exact_hit_bytes + rep[2].fill_bytes == rep[2].logical_bytes
    if preset == "all":
        assert rep[0].payload_bytes < rep[0].logical_bytes


def test_decisions_do_not_depend_on_partitions(mixed):
    policy = Policy.preset("all", profile=cdc.CdcProfile(6, 50, 256, 1024, 16384))
    one, many = (sorted(map(tuple, reduction.reduce(mixed.repartition(n), policy).report().collect())) for n in (1, 7))
    assert one == many


def test_policies():
    for bad in ({"raw", "delta"}, {"raw", "grouping"}, {"cdc"}, {"raw", "magic"}):
        with pytest.raises(ValueError):
            Policy(frozenset(bad))
    assert len({Policy.preset(p).policy_id for p in PRESETS}) == len(PRESETS)
    assert Policy.preset("all").policy_id != Policy.preset("all", trials=3).policy_id


def test_delta_trials(spark):
    rng = np.random.default_rng(2)
    raw = rng.integers(0, 256, 8192, dtype=np.uint8).tobytes()
    near = bytearray(raw)
    near[100] ^= 1
    rows = [(i, hashlib.sha256(x).hexdigest(), len(x), x) for i, x in enumerate([raw, bytes(near), rng.integers(0, 256, 8192, dtype=np.uint8).tobytes()])]
    chunks = spark.createDataFrame(rows, "object_id long, chunk_id string, length long, bytes binary")
    found = similarity.candidates(similarity.fingerprints(chunks))
    assert [(r.object_id, r.candidate_id) for r in found.collect()] == [(1, rows[0][1])]
    got = similarity.delta_trials(found, chunks.select("chunk_id", "bytes", F.col("length").alias("independent_bytes"))).collect()
    assert [(r.object_id, r.cost, r.accepted) for r in got] == [(1, 36 + 9, True)]


def test_encodings(spark):
    rows = [(0, os.urandom(200000), 1), (1, b"abc" * 80000, 1), (2, os.urandom(5000), 1)]
    regions = spark.createDataFrame(rows, "id long, bytes binary, chunks long")
    done = encoding.encode(regions).withColumn("raw_bytes", F.octet_length("bytes")).drop("bytes")
    assert {r.id: r.encoding for r in done.collect()} == {0: "RAW", 1: "ZSTD", 2: "RAW"}
    assert {r.id: bytes(r.bytes) for r in encoding.decode(done).collect()} == {k: b for k, b, _ in rows}
    for mode, first in (("v1", "RAW"), ("lz4", "RAW"), ("off", "BYPASS")):
        got = {r.id: r.decision for r in encoding.gate(regions, mode).collect()}
        assert got[0] == first and got[2] == "BYPASS" and (mode == "off" or got[1] == "ZSTD_TRIAL")


def test_dictionary(spark):
    words = [f"record {i % 50} of tenant {i % 7} path /srv/{i % 11}/file state active;".encode() * 3 for i in range(2000)]
    samples = spark.createDataFrame(list(enumerate(words)), "ord long, bytes binary")
    d = encoding.train_dictionary(samples, 4096)
    assert d == encoding.train_dictionary(samples.repartition(5), 4096) and 0 < len(d) <= 4096
    got = encoding.dictionary_trial(samples.limit(20), d).collect()
    assert all(r.choice == ("DICTIONARY" if r.dictionary_bytes < r.plain_bytes else "PLAIN") for r in got)



def test_replay_examples(spark):
    events = [(0, "EXACT_REUSE", 1)] + [(i, "PUBLISHED", i + 1) for i in range(1, 40)] + [(40, "LOOKUP", 1)]
    trace = spark.createDataFrame([(s, k, key, 69632) for s, k, key in events], "seq long, kind string, key long, verify_bytes long")
    got = {r.policy: r for r in replay.replay(trace, ["s3fifo", "sieve"], [192 * 10]).collect()}
    assert got["s3fifo"].hits == 1 and got["s3fifo"].avoided_bytes == 69632
    assert got["sieve"].misses == 1 and got["sieve"].avoided_bytes == 0
    assert max(r.most_steps for r in got.values()) <= 10


def test_sieve_rejects_when_all_are_visited():
    events = [("PUBLISHED", 1, 9), ("PUBLISHED", 2, 9), ("LOOKUP", 1, 0), ("LOOKUP", 2, 0), ("PUBLISHED", 3, 9)]
    n = replay.replay_events(events, "sieve", 192 * 2)
    assert (n["rejections"], n["evictions"], n["most_steps"]) == (1, 0, 2)


def test_cold_lookup_costs_nothing():
    n = replay.replay_events([("LOOKUP", 5, 0), ("PUBLISHED", 5, 69632), ("LOOKUP", 5, 0)], "s3fifo", 192 * 4)
    assert (n["hits"], n["misses"], n["required_bytes"], n["avoided_bytes"]) == (1, 1, 0, 69632)


@pytest.mark.parametrize("policy", ["s3fifo", "sieve"])
def test_replay_stays_within_capacity(policy):
    draw = random.Random(1)
    cache = replay.POLICIES[policy](13)
    for _ in range(3000):
        cache.access(draw.randrange(60)) if draw.random() < 0.5 else cache.admit(draw.randrange(60), draw.random() < 0.1)
        assert len(cache.uses if policy == "s3fifo" else cache.visited) <= 13


def test_overlay_and_contents(spark):
    draw = random.Random(4)
    rows, dense = [], {f: bytearray(300) for f in range(3)}
    for seq in range(60):
        f, at = draw.randrange(3), draw.randrange(250)
        data = bytes(draw.randrange(1, 256) for _ in range(draw.randrange(0, 50)))
        rows.append((f, seq, at, data))
        dense[f][at : at + len(data)] = data
    writes = spark.createDataFrame(rows, "file_id long, seq long, range_start long, bytes binary")
    seen = {f: bytearray(300) for f in range(3)}
    for r in files.contents(writes).collect():
        seen[r.file_id][r.range_start : r.range_end] = bytes(r.bytes)
    assert seen == dense


def test_ranges_against_sets(spark):
    draw = random.Random(6)
    def some(n):
        return [(draw.randrange(2), a := draw.randrange(80), a + draw.randrange(0, 12)) for _ in range(n)]
    a, b = some(20), some(15)
    cells = lambda rows: {(f, i) for f, x, y in rows for i in range(x, y)}
    df = lambda rows: spark.createDataFrame(rows, "file_id long, range_start long, range_end long")
    merged = [tuple(r) for r in intervals.coalesce_ranges(df(a)).collect()]
    assert cells(merged) == cells(a) and all(not (f == g and y == x2) for f, _, y in merged for g, x2, _ in merged)
    assert cells([tuple(r) for r in intervals.subtract_ranges(df(a), df(b)).collect()]) == cells(a) - cells(b)


def test_clone_range(spark):
    extents = spark.createDataFrame([(1, 0, 0, 100, "DATA"), (1, 1, 100, 50, "HOLE"), (1, 2, 150, 50, "DATA")], "file_id long, ordinal long, logical_offset long, length long, kind string")
    clones = spark.createDataFrame([(0, 1, 0, 2, 0, 100), (1, 1, 90, 2, 0, 20), (2, 1, 150, 2, 0, 60), (3, 1, 0, 1, 40, 50), (4, 1, 500, 2, 0, 0)], "clone_id long, source_file long, source_offset long, target_file long, target_offset long, length long")
    got = {r.clone_id: r.status for r in intervals.clone_range(extents, clones).collect()}
    assert got == {0: "OK", 1: "UNSUPPORTED", 2: "INVALID", 3: "UNSUPPORTED", 4: "OK"}


def test_files(spark):
    ops = [(1, "CREATE", 0, "a", 10, None, None, 0, 0), (2, "CREATE", 0, "b", 11, None, None, 0, 0), (3, "RENAME", 0, "a", 10, 0, "c", 0, 0), (4, "UNLINK", 0, "b", 11, None, None, 0, 0), (5, "WRITE", None, None, 10, None, None, 100, 20), (6, "SET_LENGTH", None, None, 10, None, None, 0, 50), (7, "APPEND", None, None, 10, None, None, 0, 5), (8, "WRITE", None, None, 10, None, None, 10, 0)]
    df = spark.createDataFrame(ops, "seq long, op string, parent long, name string, inode long, new_parent long, new_name string, offset long, length long")
    assert [tuple(r) for r in files.namespace(df).collect()] == [(0, "c", 10)]
    assert [tuple(r) for r in files.attributes(df).collect()] == [(10, 55, 7)]


def test_dedup_round_trip(spark, mixed):
    chunks = segments.content_chunks(mixed, SMALL, None)
    payload = chunks.dropDuplicates(["chunk_id", "length"]).select("chunk_id", "length", "bytes")
    got = dedup.restore(dedup.recipe(chunks.drop("bytes")), payload).collect()
    assert {r.object_id: bytes(r.bytes) for r in got} == {r.object_id: bytes(r.bytes) for r in mixed.collect() if r.bytes}
    assert all(r.verified for r in got)
    first = payload.orderBy("chunk_id").first()
    broken = payload.withColumn("bytes", F.when(F.col("chunk_id") == first.chunk_id, F.lit(b"?")).otherwise(F.col("bytes")))
    assert not all(r.verified for r in dedup.restore(chunks.drop("bytes"), broken).collect())
    assert dedup.missing(chunks.where("kind = 'DATA'").withColumnRenamed("length", "logical_length"), payload.withColumnRenamed("length", "logical_length")).count() == 0


def test_packing(spark):
    rows = [(g, i, n) for g in range(3) for i, n in enumerate([5, 5, 1, 20, 3, 8, 2])]
    df = spark.createDataFrame(rows, "g long, i long, n long")
    got = {(r.g, r.i): r.bin for r in packing.pack(df, "g", ["i"], "n", 10).collect()}
    assert [got[1, i] for i in range(7)] == [0, 0, 1, 2, 3, 4, 4]
    got = {(r.g, r.i): r.container for r in packing.flush_bins(df, "g", ["i"], "n", 10).collect()}
    assert [got[2, i] for i in range(7)] == [0, 0, 1, 1, 2, 2, 3]


def test_slot_selection(spark):
    schema = "log_id long, first_generation long, last_generation long, records long, last_hash string, first_hash string"
    a = spark.createDataFrame([(1, 1, 5, 5, "h5", "h1"), (2, 5, 9, 5, "h9", "h5"), (3, 1, 5, 5, "h5", "h1"), (4, 5, 9, 5, "h9", "zz")], schema)
    b = spark.createDataFrame([(1, 3, 5, 3, "h5", "h3"), (2, 1, 5, 5, "h5", "h1"), (3, 1, 5, 6, "other", "h1"), (4, 1, 5, 5, "h5", "h1")], schema)
    assert {r.log_id: r.slot for r in generations.select_slot(a, b).collect()} == {1: "A", 2: "A", 3: "CONFLICT", 4: "CONFLICT"}


def test_priorities(spark):
    pools = spark.createDataFrame([(899, 1000, 199, 1000), (900, 1000, 200, 1000), (899, 1000, 201, 1000)], "used long, capacity long, reclaimable long, container_bytes long")
    assert [(r.scrub, r.gc) for r in maintenance.priorities(pools).collect()] == [("BACKGROUND", "BACKGROUND"), ("NORMAL", "NORMAL"), ("BACKGROUND", "NORMAL")]


def test_replacement_packing(spark):
    chunks = spark.createDataFrame([("c1", 0, "a", 10), ("c1", 1, "b", 10), ("c2", 0, "a", 10), ("c3", 0, "d", 10)], "container_id string, chunk_ordinal long, chunk_id string, logical_length long")
    need = chunks.select("chunk_id", "logical_length").where("chunk_id IN ('a', 'd')").distinct()
    order = maintenance.replacement_order(chunks, need, spark.createDataFrame([("c1",), ("c2",)], "container_id string"))
    assert [tuple(r) for r in order.collect()] == [("c1", 0, "a", 10)]
    packed = order.withColumn("batch", F.lit(0)).withColumn("place", F.lit(0))
    ids = [maintenance.replacement_id(packed, "d", g).first().container_id for g in (1, 1, 2)]
    assert ids[0] == ids[1] != ids[2]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    assert s.current() is None
    s.publish(spark.range(3))
    s.publish(spark.range(5), 10)
    with pytest.raises(RuntimeError):
        s.publish(spark.range(9), fail_before_log=True)
    assert s.read().count() == 5 and s.read(1).count() == 3 and s.current()[0] == 2
    s.publish(spark.range(7), 11)
    assert s.read().count() == 7 and s.log().where("valid").count() == 3
    meta = spark.createDataFrame([("leaf", b"x"), ("leaf", b"x"), ("root", b"x")], "kind string, payload binary")
    ids = s.put_metadata(meta)
    s.put_metadata(meta)
    got = s.get_metadata(ids).collect()
    assert len(got) == 2 and all(r.verified for r in got)


def test_store_has_one_publisher(spark, tmp_path):
    held = store.Store(spark, f"file://{tmp_path}/one")
    held.publish(spark.range(3))
    held.claim(2)
    with pytest.raises(RuntimeError, match="another publisher"):
        held.publish(spark.range(4))
    held.release(2)
    assert held.publish(spark.range(5)) == 2 and held.read().count() == 5


def test_sources(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"0123456789")
    got = store.read_range(store.objects_from_files(spark, str(tmp_path)), 2, 4).collect()
    assert [bytes(r.bytes) for r in got] == [b"2345"]
    assert store.inventory(spark, 1).count() == 3200 and store.inventory(spark, 3).count() == 3200 - 7 + 24


def test_stream_of_writes(spark, tmp_path):
    profile = cdc.CdcProfile(3, 20, 40, 64, 512)
    raw = {i: np.random.default_rng(i).integers(0, 256, 9000, dtype=np.uint8).tobytes() for i in range(3)}
    rows = [(i, k, k * 700, raw[i][k * 700 : (k + 1) * 700], (k + 1) * 700 >= len(raw[i])) for i in raw for k in range(13)]
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "inode long, seq long, offset long, data binary, closed boolean"
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] % 13 // 5 == part], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.commit_batches(ingest.lane_chunks(stream, profile), target, str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.option("recursiveFileLookup", "true").parquet(target).collect()
    for i in raw:
        ends = cdc.cuts(raw[i], profile)
        want = {(a, b - a) for a, b in zip([0, *ends], ends)}
        assert {(r.input_offset, r.length) for r in got if r.inode == i} == want


def test_windowed_activity(spark):
    got = ingest.windowed_activity(spark.read.parquet(f"{SF}/events.parquet"), "1 day")
    assert got.agg(F.sum("events")).first()[0] == 1000


def test_report_rules(spark):
    one = spark.range(1).select(
        report.zstd_accepts(F.lit(100000), F.lit(95000)).alias("a"), report.zstd_accepts(F.lit(100000), F.lit(97000)).alias("b"), report.zstd_accepts(F.lit(1000000), F.lit(980000)).alias("c"), report.delta_accepts(F.lit(100000), F.lit(95000)).alias("d")
    )
    assert tuple(one.first()) == (True, False, False, True)


def test_contents_after_set_length(spark):
    """Bytes beyond a shorter length never come back, whatever is written later; committed bytes lie beneath."""
    draw = random.Random(9)
    writes, lengths, dense = [], [], {f: bytearray(b"base" * 10) for f in range(3)}
    for seq in range(80):
        f = draw.randrange(3)
        if draw.random() < 0.3:
            n = draw.randrange(120)
            lengths.append((f, seq, n))
            dense[f] = dense[f][:n] + bytearray(max(0, n - len(dense[f])))
        else:
            at, data = draw.randrange(100), bytes(draw.randrange(1, 256) for _ in range(draw.randrange(1, 30)))
            writes.append((f, seq, at, data))
            dense[f] += bytearray(max(0, at + len(data) - len(dense[f])))
            dense[f][at : at + len(data)] = data
    base = spark.createDataFrame([(f, 0, b"base" * 10) for f in range(3)], "file_id long, range_start long, bytes binary")
    seen = {f: bytearray(200) for f in range(3)}
    got = files.contents(spark.createDataFrame(writes, "file_id long, seq long, range_start long, bytes binary"), spark.createDataFrame(lengths, "file_id long, seq long, length long"), base)
    for r in got.collect():
        seen[r.file_id][r.range_start : r.range_end] = bytes(r.bytes)
    assert {f: bytes(x[: len(dense[f])]) for f, x in seen.items()} == {f: bytes(x) for f, x in dense.items()}


def test_name_operations(spark):
    ops = [(1, "CREATE", 1, "a", 10, None, None, False), (2, "CREATE", 1, "a", 11, None, None, False), (3, "LOOKUP", 1, "b", None, None, None, False), (4, "RENAME", 1, "b", 9, 1, "c", False), (5, "CREATE", 1, "d", 12, None, None, False), (6, "RENAME", 1, "a", 10, 1, "d", True), (7, "RENAME", 1, "a", 10, 1, "d", False), (8, "UNLINK", 1, "a", 10, None, None, False), (9, "UNLINK", 1, "d", 10, None, None, False), (10, "OPEN", None, None, 10, None, None, False), (11, "OPEN", None, None, 12, None, None, False), (12, "RELEASE", None, None, 12, None, None, False)]
    df = spark.createDataFrame(ops, "seq long, op string, parent long, name string, inode long, new_parent long, new_name string, no_replace boolean")
    got = {r.seq: r.result for r in files.results(df.where("seq < 10")).collect()}
    assert [got[i] for i in range(1, 10)] == ["OK", "EXISTS", "NO_ENTRY", "NO_ENTRY", "OK", "EXISTS", "OK", "NO_ENTRY", "OK"]
    assert [r.inode for r in files.orphans(df).collect()] == [10]


def test_rewrite_and_read_against_bytes(spark):
    """Splices, truncations and reads of recipes give what they give on bytes."""
    draw = random.Random(12)
    payload = {f"c{i}": bytes(draw.randrange(256) for _ in range(40)) for i in range(6)}
    extents, dense = [], {}
    for f in range(6):
        at, data = 0, b""
        for k in range(8):
            kind, n, c = draw.choice(["DATA", "SLICE", "HOLE", "FILL"]), draw.randrange(1, 30), draw.choice(sorted(payload))
            skip = draw.randrange(0, 40 - n) if kind == "SLICE" else 0
            n = 40 if kind == "DATA" else n
            extents.append((f, k, at, n, kind, c if kind in ("DATA", "SLICE") else None, skip, 40, 7))
            data += payload[c][skip : skip + n] if kind in ("DATA", "SLICE") else bytes([7 if kind == "FILL" else 0]) * n
            at += n
        dense[f] = data
    ext = spark.createDataFrame(extents, "file_id long, ordinal long, logical_offset long, length long, kind string, chunk_id string, chunk_offset long, chunk_length long, fill_value int")
    chunks = spark.createDataFrame(list(payload.items()), "chunk_id string, bytes binary")
    whole = spark.createDataFrame([(f, 0, 1000) for f in dense], "file_id long, range_start long, range_end long")
    fill = lambda e: e.withColumn("fill_value", F.lit(7))
    read = lambda e, r=whole: {x.file_id: bytes(x.bytes) for x in intervals.read_bytes(e, r, chunks).collect()}
    assert read(ext) == dense
    cut = {f: draw.randrange(len(b) + 40) for f, b in dense.items()}
    shorter = intervals.truncate(ext, spark.createDataFrame(list(cut.items()), "file_id long, new_size long"))
    assert read(fill(shorter)) == {f: b[: cut[f]].ljust(cut[f], b"\0") for f, b in dense.items()}
    edits = {f: sorted(draw.sample(range(len(b)), 2)) for f, b in dense.items()}
    new = spark.createDataFrame([(f, 0, 5, "FILL", None, 0, 0) for f in dense], "file_id long, logical_offset long, length long, kind string, chunk_id string, chunk_offset long, chunk_length long")
    spliced = intervals.rewrite(ext, spark.createDataFrame([(f, a, z) for f, (a, z) in edits.items()], "file_id long, range_start long, range_end long"), new, resize=True)
    assert read(fill(spliced)) == {f: b[: edits[f][0]] + b"\7" * 5 + b[edits[f][1] :] for f, b in dense.items()}
    same = intervals.rewrite(ext, spark.createDataFrame([(0, 3, 8), (1, 3, 9)], "file_id long, range_start long, range_end long"), new)
    got = read(fill(same))
    assert got[0] == dense[0][:3] + b"\7" * 5 + dense[0][8:] and got[1] == dense[1]
    lost = intervals.read_bytes(ext, whole, chunks.where("chunk_id <> 'c1'"))
    assert {r.file_id for r in lost.collect() if r.bytes is None} == {f for f, _, _, _, _, c, *_ in extents if c == "c1"}


def test_cascade_is_step_by_step_compaction(spark):
    rows = [(f"k{i % 9}", 100, f"c{i % 4}", 0, 0, i, level, family, "ACTIVE" if i % 3 else "REMOVED") for i, (level, family) in enumerate([(0, 1), (0, 2), (0, 3), (1, 4), (1, 5), (1, 6)] * 7)]
    schema = "chunk_id string, logical_length long, container_id string, record_offset long, chunk_ordinal long, generation long, level long, family long, transition string"
    entries, new = spark.createDataFrame(rows, schema), spark.createDataFrame([("k1", 100, "c9", 0, 0, 99, 0, 0, "ACTIVE")], schema)
    got = sorted(map(tuple, index.publish(entries, new, 10).collect()))
    now = entries.unionByName(new.withColumn("level", F.lit(0).cast("long")).withColumn("family", F.lit(10).cast("long")))
    for generation in range(11, 20):
        chosen = index.compaction_selection(index.families(now)).cache()
        if chosen.isEmpty():
            break
        now = index.compact(now, chosen, generation).cache()
    assert got == sorted(map(tuple, now.select(*entries.columns).collect())) and generation > 12
    with pytest.raises(ValueError, match="COUNT"):
        index.compact(entries, entries.select("level", "family").where("family = 1").distinct(), 50)
    with pytest.raises(ValueError, match="TARGET"):
        index.compact(entries, entries.select("level", "family").distinct(), 3)


def test_lookup_is_never_complete_when_full(spark):
    rows = [(k, 1, f"c{i:03}", 0, 0, i, 0, "ACTIVE") for k, n in (("a", 63), ("b", 64), ("c", 65)) for i in range(n)] + [("c", 1, "c001", 0, 0, 900, 0, "REMOVED")]
    entries = spark.createDataFrame(rows, "chunk_id string, logical_length long, container_id string, record_offset long, chunk_ordinal long, generation long, level long, transition string")
    got = {r.chunk_id: (r.n, r.c) for r in index.lookup(entries).groupBy("chunk_id").agg(F.count("*").alias("n"), F.bool_and("complete").alias("c")).collect()}
    assert got == {"a": (63, True), "b": (64, False), "c": (64, False)}
    assert {r.chunk_id: r.candidates for r in index.resolve(entries).collect()}["c"] == "c064:0:0,c063:0:0"


def test_transition_rules(spark):
    roots = spark.createDataFrame([(1, 0, 10, 2), (2, 5, 20, 8), (3, 9, 20, 8), (4, 8, 30, 9), (5, 9, 25, 9), (6, 9, 30, 8), (7, 9, 40, 35)], "generation long, mutation_sequence long, reservation_end long, allocation_cursor long")
    inodes = spark.createDataFrame([(2, 3, 1), (2, 7, 4), (3, 3, 1), (3, 5, 2), (4, 3, 0), (5, 3, 0), (5, 8, 1), (6, 3, 0), (7, 3, 0), (7, 9, 1)], "generation long, inode long, mutation_sequence long")
    got = sorted((r.generation, r.fault, r.inode or 0) for r in generations.transition_faults(roots, inodes).collect())
    assert got == [(3, "REUSED_INODE", 5), (4, "INODE_BACK", 3), (4, "MUTATION_BACK", 0), (5, "RESERVATION_BACK", 0), (5, "REUSED_INODE", 8), (6, "ALLOCATION_BACK", 0), (7, "BEYOND_RESERVATION", 0)]
    assert sorted(r.generation for r in generations.valid_prefix(roots, inodes).collect()) == [1, 2]
    log = spark.createDataFrame([(1, 1, 1, None, "a", True, 1, 5, 2, False), (1, 2, 2, "a", "b", True, 1, 4, 2, False), (2, 1, 1, None, "a", True, 1, 5, 2, False), (2, 2, 2, "a", "b", True, 2, 5, 2, True)], "log_id long, position long, generation long, previous_hash string, record_hash string, checksum_ok boolean, mutation_cutoff long, reservation_end long, allocation_cursor long, torn boolean")
    assert {r.log_id: (r.valid_records, r.tail) for r in generations.log_tail(log).collect()} == {1: (1, "BROKEN_CHAIN"), 2: (1, "TORN")}


def test_slots_of_one_length_must_have_the_same_bytes(spark):
    schema = "log_id long, first_generation long, last_generation long, records long, last_hash string, first_hash string, bytes_hash string, tail string"
    a = spark.createDataFrame([(1, 1, 5, 5, "h", "f", "x", "CLEAN"), (2, 1, 5, 5, "h", "f", "x", "TORN"), (3, 1, 5, 5, "h", "f", "x", "CLEAN"), (4, None, None, 0, None, None, "", "TORN"), (5, None, None, 0, None, None, "", "CLEAN")], schema)
    b = spark.createDataFrame([(1, 1, 5, 5, "h", "f", "x", "TORN"), (2, 1, 5, 5, "h", "f", "x", "CLEAN"), (3, 1, 5, 5, "h", "f", "y", "CLEAN"), (4, 1, 5, 5, "h", "f", "x", "CLEAN"), (5, 1, 5, 5, "h", "f", "x", "CLEAN")], schema)
    assert {r.log_id: r.slot for r in generations.select_slot(a, b).collect()} == {1: "A", 2: "B", 3: "CONFLICT", 4: "BROKEN", 5: "B"}


def test_fence_and_contract(spark):
    events = [(1, 1, "accept", 1), (1, 2, "accept", 2), (1, 3, "complete", 2), (1, 4, "complete", 1), (1, 5, "complete", 2), (1, 6, "complete", 3), (2, 1, "complete", 1), (2, 2, "accept", 1)]
    got = {r.handle: (r.accepted, r.applied, r.refused, r.close_ready) for r in report.handle_fence(spark.createDataFrame(events, "handle long, seq long, op string, sequence long")).collect()}
    assert got == {1: (2, 2, 2, True), 2: (1, 0, 1, False)}
    k = 4096
    top = (1 << 63) - k
    base = dict(source_size=8 * k, target_size=8 * k, source_offset=0, target_offset=0, length=k, alignment=k, maximum_length=16 * k, same_file=False)
    cases = [({}, "OK"), ({"length": 0}, "INVALID_PARAMETER"), ({"alignment": 2048}, "INVALID_PARAMETER"), ({"alignment": 12288}, "INVALID_PARAMETER"), ({"maximum_length": 0}, "INVALID_PARAMETER"), ({"length": 17 * k}, "CLONE_TOO_LARGE"), ({"source_offset": 1}, "MISALIGNED"), ({"source_offset": top}, "INVALID_PARAMETER"), ({"target_offset": top}, "INVALID_PARAMETER"), ({"source_offset": 8 * k}, "SOURCE_OUT_OF_BOUNDS"), ({"target_offset": 8 * k}, "TARGET_NOT_PRESIZED"), ({"same_file": True}, "OVERLAP"), ({"same_file": True, "target_offset": k}, "OK")]
    rows = [(i, *(base | change).values()) for i, (change, _) in enumerate(cases)]
    got = intervals.clone_contract(spark.createDataFrame(rows, "i int, source_size long, target_size long, source_offset long, target_offset long, length long, alignment long, maximum_length long, same_file boolean")).collect()
    assert [r.status for r in sorted(got, key=lambda r: r.i)] == [want for _, want in cases]


def test_payload_cap_counts_each_raw_record(spark):
    rows = spark.createDataFrame([([100000],), ([50000, 50000],), ([4096] * 10,), ([100],)], "lengths array<long>")
    got = rows.select(report.payload_cap(report.raw_records("lengths"), F.size("lengths")).alias("cap")).collect()
    want = []
    for lengths in ([100000], [50000, 50000], [4096] * 10, [100]):
        raw = sum(-(-(n + 192) // 64) * 64 for n in lengths)
        room = max(0, raw - max(4096, -(-raw * 3 // 100)))
        want.append(max(0, room - room % 64 - 128 - 64 * len(lengths)))
    assert [r.cap for r in got] == want


def test_collection_loses_nothing(spark):
    chunks = [(f"c{i // 4}", i % 4, f"k{i}", 1000) for i in range(40)]
    online = [(f"k{i}", 1000) for i in range(40) if i % 4 == 1 or i < 8]
    schema = "container_id string, chunk_ordinal long, chunk_id string, logical_length long"
    before, need = spark.createDataFrame(chunks, schema), spark.createDataFrame(online, "chunk_id string, logical_length long")
    sizes = before.groupBy("container_id").agg(F.lit(50000).cast("long").alias("file_bytes"))
    after = maintenance.collect_garbage(before, need, sizes, "d", 3)
    rows = after.collect()
    assert {r.container_id for r in rows if r.origin == "KEPT"} == {"c0", "c1"} and sorted(r.chunk_id for r in rows if r.origin == "NEW") == sorted(f"k{i}" for i in range(8, 40) if i % 4 == 1)
    assert maintenance.collection_faults(before, after, need).isEmpty()
    assert maintenance.collection_faults(before, after.where("origin = 'KEPT'"), need).count() == 8
    order = spark.createDataFrame([("c1", i, f"k{i}", 400) for i in range(7)], schema)
    got = {r.chunk_ordinal: (r.batch, r.place) for r in maintenance.replacement_batches(order, 1000, 5).collect()}
    assert [got[i] for i in range(7)] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1), (3, 0)]


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.ORACLES[name])
    columns = sorted(df.columns)
    there = [d[0] for d in want.description]
    assert columns == sorted(there)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    a = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=key)
    b = sorted((tuple(_plain(r[there.index(c)]) for c in columns) for r in want.fetchall()), key=key)
    assert a == b
