"""N-gram Jaccard join by MinHash banding.

Texts become sets of word n-grams. Equal sets form a class; from there on one representative of each class works. A representative's MinHash
signature is cut into bands; band and row counts are chosen for a target recall at the threshold (``bands_for``). Band hashes are shuffled,
and representatives that share a band hash are connected through the bucket, never as pairs, into candidate components. A component is dealt into
blocks, and two blocks meet in a square tile of bounded size, to which only members go that share a bucket with a member of the other block; there
all candidate pairs (those that share a band) are verified on full n-gram sets. So a component of thousands of near copies is spread over tasks, a long chain
of texts that each resemble the next costs rows in proportion to its length, and every link between different texts is found. A tile returns link counts
and a spanning forest of its links, not the links themselves. Components of verified links are the result's classes.

Defined cases: words are runs of letters and digits in lower case; a text of 1 to n - 1 words has one n-gram, all its words; a text
without words, or null, is a class of its own by its text's hash and links only to equal texts; repeated rows count as copies; very long texts are
read whole; a similarity of exactly the threshold links (ties); an empty table gives no rows. Null ids are allowed; a class is named by its smallest
id; a kept column with the name of one of the operator's own gives way to it. An n-gram set is named by 128 bits.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import BATCH_ROWS, Scratch, components, documents, join_counted, packed, slices, unpacked

NGRAM = 5
THRESHOLD = 0.8
#: Probability that a pair at the threshold shares a band.
RECALL = 0.9999
#: Hash functions at most.
MAX_HASHES = 128
#: Representatives on one side of a tile.
TILE = 256
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding, with the most rows, that reaches the recall within the hashes allowed; an error if none does."""
    best = None
    for rows in range(1, most + 1):
        share = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-share)) if 0 < share < 1 else 1 if share else most + 1
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"{most} hashes do not reach a recall of {recall} at a similarity of {threshold}")
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ngrams(text: str | None, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a whole text."""
    words = _WORD.findall(text.lower().encode()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    size = min(n, len(h))
    total = np.zeros(len(h) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = _mix((total ^ h[k : len(h) - size + 1 + k]) + _GOLD)
    return np.unique(total)


def signature(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band."""
    seeds = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * _GOLD)
    least = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 256):  # a working set that fits the cache, whatever the text's length
        np.minimum(least, _mix(grams[at : at + 256][None, :] ^ seeds[:, None]).min(axis=1), out=least)
    least = least.reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        out = _mix((out ^ least[:, r]) + _GOLD)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _prepare(texts: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Adds c and keys to rows whose last column is the text, which goes: c is a 128-bit name of the n-gram set, of the text if the set is
    empty; keys are the band hashes, none for an empty set. The n-grams themselves are not kept."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1]), "c binary, keys array<long>"])

    def run(batches):
        for b in slices(batches):
            names, keys = [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                grams = ngrams(t, n)
                names.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else b"-" + (b"" if t is None else xxhash.xxh3_128_digest(t.encode())))
                keys.append(_signed(signature(grams, bands, rows)).tolist() if len(grams) else [])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=[*b.schema.names[:-1], "c", "keys"])

    return texts.mapInArrow(run, schema)


def _with_grams(texts: DataFrame, n: int) -> DataFrame:
    """(node, grams) of rows (node, t)."""

    def run(batches):
        for b in slices(batches):
            sets = [ngrams(t, n).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "grams"])

    return texts.select("node", "t").mapInArrow(run, "node binary, grams binary")


def _roots(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def verify_tile(left, right, same: bool, threshold: float):
    """Links between two lists of (node, keys, grams, weight): (counts by node, spanning edges). Only pairs that share a band are compared."""
    lk, rk = np.array([x[1] for x in left]), np.array([x[1] for x in right])
    maybe = np.zeros((len(left), len(right)), bool)
    for band in range(lk.shape[1]):
        maybe |= lk[:, band][:, None] == rk[:, band][None, :]
    if same:
        maybe = np.triu(maybe, 1)
    links, edges = {}, []
    parent = {x[0]: x[0] for x in [*left, *right]}
    for i in np.flatnonzero(maybe.any(axis=1)):
        node, _, grams, weight = left[i]
        others = np.flatnonzero(maybe[i])
        sizes = np.array([len(right[j][2]) for j in others])
        # The members of this row's set are found in all partners' sets at once.
        joined = np.concatenate([right[j][2] for j in others])
        at = np.searchsorted(grams, joined)
        at[at == len(grams)] = 0
        both = np.add.reduceat((grams[at] == joined).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        good = both >= threshold * (len(grams) + sizes - both) - 1e-9
        for j in others[good]:
            other = right[j]
            links[node] = links.get(node, 0) + other[3]
            links[other[0]] = links.get(other[0], 0) + weight
            a, b = _roots(parent, node), _roots(parent, other[0])
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((node, other[0]))
    return links, edges


def _verify(tiles: DataFrame, threshold: float) -> DataFrame:
    """tiles: sorted rows (tile, same, side, node, keys, grams, weight) -> (a, b, n): link counts (node, null, n) and edges (a, b, null)."""

    def close(same, rows):
        left = [r for s, r in rows if s == 0]
        right = left if same else [r for s, r in rows if s == 1]
        links, edges = verify_tile(left, right, same, threshold)
        out = [*((node, None, n) for node, n in links.items()), *((a, b, None) for a, b in edges)]
        xs, ys, counts = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary()), pa.array(counts, pa.int64())], names=["a", "b", "n"])

    def run(batches):
        now, same, rows = None, False, []
        for batch in slices(batches):
            for tile, eq, side, node, keys, grams, weight in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and tile != now:
                    yield close(same, rows)
                    rows = []
                now, same = tile, eq
                rows.append((side, (node, keys, np.frombuffer(grams, np.uint64), weight)))
        if rows:
            yield close(same, rows)

    return tiles.mapInArrow(run, "a binary, b binary, n long")


def near_duplicates(docs: DataFrame, scratch: Scratch, *keep: str, text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """Rows (keep, class_id, copy_id, n_copies, n_links), one for each row of ``docs``; ``keep`` holds the id first.

    class_id: smallest id of the near-duplicate class; copy_id: smallest id of the documents with the same n-gram set, n_copies
    their number; n_links: number of other documents with a Jaccard similarity of ``threshold`` or more.
    """
    bands, rows = bands_for(threshold, recall)
    key = F.unhex(F.md5(F.col(text).cast("binary")))
    rows_of = packed(docs, keep, F.col(f"`{keep[0]}`").alias("id"), key.alias("k"), F.col(text).alias("t"))
    rows_of = scratch.write(_prepare(rows_of, n, bands, rows), "prepared", BATCH_ROWS)
    # Ids and numbers of copies by set; equal texts have equal sets. Hot sets are combined before the shuffle.
    sets = rows_of.groupBy(F.col("c").alias("node")).agg(F.min("id").alias("copy_id"), F.count("*").alias("n_copies"), F.min("k").alias("k"))
    sets = scratch.write(sets, "sets")
    banded = scratch.write(rows_of.where("size(keys) > 0").select(F.col("c").alias("node"), "keys").dropDuplicates(["node"]), "banded")
    entries = banded.select("node", F.posexplode("keys").alias("band", "h"))
    buckets = scratch.write(entries.groupBy("band", "h").agg(F.min("node").alias("hub"), F.count("*").alias("m")).where("m > 1"), "buckets")
    star = entries.join(buckets, ["band", "h"]).where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    groups = scratch.write(components(star, scratch, "candidates"), "groups")
    # Places within a component: hashed blocks of about ``tile`` members.
    counts = groups.groupBy("root").agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / tile).cast("int")).drop("m")
    block = F.pmod(F.xxhash64("node", F.lit(17)), F.col("blocks")).cast("int")
    members = groups.join(counts, "root").select("node", "root", "blocks", block.alias("block"))
    members = members.join(banded, "node").join(sets.select("node", "k", F.col("n_copies").alias("weight")), "node")
    members = scratch.write(members, "members")
    scratch.drop("groups", "banded")
    # Only representatives with a candidate get their n-grams, from one text each; copies of a hot one are combined where they are.
    texts = join_counted(docs.select(key.alias("k"), F.col(text).alias("t")), members.select("k", "node", "weight"), ["k"], "weight").dropDuplicates(["k", "node"])
    with_grams = members.join(_with_grams(texts, n), "node").join(_reach(members, buckets), "node")
    # Block i meets blocks i..: side 0 in its own row of tiles, side 1 in the tiles of smaller blocks.
    pairs = F.explode(F.transform("reach", lambda j: F.struct(F.least("block", j).alias("x"), F.greatest("block", j).alias("y"))))
    dealt = with_grams.withColumn("at", pairs).select(
        F.concat_ws(":", F.hex("root"), "at.x", "at.y").alias("tile"),
        (F.col("at.x") == F.col("at.y")).alias("same"),
        (F.col("block") != F.col("at.x")).cast("int").alias("side"),
        "node", "keys", "grams", "weight",
    )
    tiles = dealt.repartition("tile").sortWithinPartitions("tile")
    found = scratch.write(_verify(tiles, threshold), "found", BATCH_ROWS)
    scratch.drop("buckets", "members")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"), scratch, "links")
    named = sets.drop("k").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(links, "node", "left")
    named = scratch.write(named, "named")
    scratch.drop("sets", "found")
    class_ids = named.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    named = named.join(class_ids, "root").select(F.col("node").alias("c"), "class_id", "copy_id", "n_copies", (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    return unpacked(rows_of.select("_keep", "c").join(named, "c"), keep, "class_id", "copy_id", "n_copies", "n_links")


def _reach(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """(node, reach): the blocks of its component in which a member shares a bucket; of components of one block that block."""
    several = members.where("blocks > 1").select("node", "block", F.posexplode("keys").alias("band", "h"))
    placed = several.join(buckets.select("band", "h"), ["band", "h"])
    # A bucket's blocks, and those with two members or more, which a member's own block must be.
    blocks = placed.groupBy("band", "h", "block").agg(F.count("*").alias("m"))
    blocks = blocks.groupBy("band", "h").agg(F.collect_list(F.struct("block", "m")).alias("there"))  # a component's blocks at most
    others = F.transform(F.filter("there", lambda x: (x.block != F.col("block")) | (x.m > 1)), lambda x: x.block)
    seen = placed.join(blocks, ["band", "h"]).select("node", others.alias("others"))
    seen = seen.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("reach"))  # an array for each band
    return members.where("blocks = 1").select("node", F.array(F.lit(0)).alias("reach")).unionByName(seen)


def op9_ngram_jaccard_join(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), Scratch(spark, "op9"), "doc_id")


QUERIES = {"op9_ngram_jaccard_join": op9_ngram_jaccard_join}
#: A join on all n-grams and a recursive closure: the plain way, for small tables.
ORACLES = {
    "op9_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 0 THEN CASE WHEN text IS NULL THEN chr(1) ELSE chr(2) || text END ELSE array_to_string(w[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, text, w, unnest(range(1, greatest(CAST(len(w) AS BIGINT) - 3, 2))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
b AS (SELECT a.doc_id AS x, c.doc_id AS y, count(*) AS k FROM g a JOIN g c ON a.g = c.g AND a.doc_id <> c.doc_id GROUP BY ALL),
l AS (SELECT x, y, k = p.n AND k = q.n AS same FROM b JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 5 * k >= 4 * (p.n + q.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
s AS (SELECT x, min(y) AS class_id FROM r GROUP BY x)
SELECT w.doc_id, class_id, least(w.doc_id, min(y) FILTER (same)) AS copy_id, 1 + count(*) FILTER (same) AS n_copies, count(y) AS n_links
FROM w JOIN s ON s.x = w.doc_id LEFT JOIN l ON l.x = w.doc_id GROUP BY w.doc_id, class_id""",
}
