"""Removal of repeated byte strings by prefix-free parsing.

A byte goes if a ``LENGTH``-byte string that covers it starts anywhere else too. The method:

* *Triggers.* A rolling hash of ``ROLL`` bytes runs over a text; the smallest hash of any ``SPREAD`` consecutive places is a trigger.
  Triggers depend on nearby bytes only, so equal strings are cut alike, and every string of ``LENGTH`` bytes has its first trigger at the
  same place, within its first ``SPREAD`` bytes.
* *Parse.* The starts that share their first trigger are a phrase; a text is a row of phrases. The ``SEED`` bytes at a phrase's trigger lie
  inside every string that starts in the phrase, so a phrase whose seed occurs once in the corpus holds no repeated string. Only
  the others are followed up. Equal phrases in a row, as in runs and short periods, are one row with a count.
* *Dictionary.* A phrase with the bytes its strings reach into is named by its seed and a fingerprint, 128 bits together. Phrases of the parse
  with equal names stand for equal strings, so a phrase that occurs twice is repeated as a whole, and each distinct phrase is looked at once.
* *Order.* A phrase carries the LENGTH - 1 bytes behind it, so the first LENGTH bytes of a suffix never leave the dictionary string, and
  the order of the parse's suffixes beyond it cannot matter. The dictionary's suffixes are told apart from coarse to fine: the starts
  of a phrase are dealt by their distance from the trigger into cells, ``BRANCH`` times narrower at each level. The strings of a cell have a
  core in common; a cell whose core occurs once goes, a cell that occurs twice as a whole is repeated, and only the other cells are cut again, down to
  single suffixes. A boundary between repeated and unique text so costs BRANCH rows a level, in hot passages as anywhere else, and each level is an
  aggregation with map-side combine and a join in which hot cores do not meet in one task. Fingerprints of cells
  stand for their rank: equality of neighbours is all that is asked of the order, so the suffix array itself is not written out.

Work and shuffles follow the number of phrases, about one in SPREAD / 2 bytes, and of distinct repeated phrases, not of bytes. A
fingerprint is a polynomial hash modulo 2^64 with random letters and multiplier; names and single suffixes have two, 128 bits.

Defined cases: a null or empty text has 0 bytes and stays as it is (the checksum of no bytes); texts shorter than ``LENGTH`` lose nothing;
very long texts are parsed whole, in slabs; repeated rows are occurrences of their own, so two equal rows of LENGTH bytes or more are removed
in both; ties between triggers go to the last; an empty table gives no rows; a kept column with the name of one of the operator's own gives way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, documents, join_counted, packed, unpacked

LENGTH = 200
ROLL = 16
#: Cells of a level are so many times narrower than those of the level before.
BRANCH = 6
#: Starts of a text, or bytes of phrases, in hand at once.
SLAB = 1 << 20


def _tables(seed: int):
    rng = np.random.default_rng(seed)
    letters = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 256, dtype=np.uint64)
    factor = int(rng.integers(1 << 60, 1 << 63, dtype=np.uint64)) | 5
    factor -= (factor - 5) % 8  # 5 modulo 8: of the greatest order
    return letters, factor


class Rolling:
    """Polynomial hashes of all substrings of a text by prefix sums: H(i, j) = (S[j] - S[i]) * factor^-i modulo 2^64."""

    def __init__(self, seed: int):
        self.letters, factor = _tables(seed)
        self.factor, self.inverse = factor, pow(factor, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.factor, m, 1 << 64))])
                self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, m, 1 << 64))])

    def sums(self, raw: np.ndarray) -> np.ndarray:
        self.powers(len(raw) + 1)
        with np.errstate(over="ignore"):
            return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.letters[raw] * self.up[: len(raw)], dtype=np.uint64)])

    def span(self, sums: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hashes of [i, j), mixed so that high and low bits are alike."""
        with np.errstate(over="ignore"):
            x = (sums[j] - sums[i]) * self.down[i]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            return x ^ (x >> np.uint64(32))


def first_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value of x[i : i + width], the last of equal ones, for each i."""
    n = len(x) - width + 1
    place = np.arange(len(x))
    best, done = place, 1
    while done < width:
        step = min(done, width - done)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(x[b] <= x[a], b, a)
        done += step
    return best[:n]


class Parser:
    """Cuts texts into phrases; ``seed_length`` and ``spread`` follow from the length."""

    def __init__(self, length: int = LENGTH, roll: int = ROLL):
        self.length, self.roll = length, min(roll, max(1, length // 4))
        self.seed_length = max(self.roll, length // 6)
        self.spread = length - self.seed_length + 1
        self.a, self.b = Rolling(11), Rolling(23)

    def phrases(self, raw: np.ndarray):
        """(begin, size, count, trigger, seed, name) of the phrases of a text, slab by slab: arrays. A row stands for ``count`` equal phrases in a
        row, of ``size`` starts each, from ``begin`` on; the trigger is counted from the phrase's begin."""
        n = len(raw) - self.length + 1
        for at in range(0, n, SLAB):
            begin, *rest = self._slab(raw[at : at + SLAB + self.length - 1])
            yield begin + at, *rest

    def _slab(self, raw: np.ndarray):
        n = len(raw) - self.length + 1
        sa, sb = self.a.sums(raw), self.b.sums(raw)
        at = np.arange(len(raw) - self.roll + 1)
        rolling = self.a.span(sa, at, at + self.roll)
        trigger = first_minimum(rolling[: n + self.spread - 1], self.spread)[:n]
        begin = np.concatenate([[0], np.flatnonzero(trigger[1:] != trigger[:-1]) + 1])
        size = np.diff(np.append(begin, n))
        t = trigger[begin]
        seed = self.b.span(sb, t, t + self.seed_length)
        name = self.a.span(sa, begin, begin + size + self.length - 1) ^ size.astype(np.uint64)
        new = np.ones(len(begin), bool)
        new[1:] = (seed[1:] != seed[:-1]) | (name[1:] != name[:-1])
        first = np.flatnonzero(new)
        return begin[first], size[first], np.diff(np.append(first, len(begin))), (t - begin)[first], seed[first], name[first]

    def cells(self, raws: list[bytes], trigger: np.ndarray, width: int):
        """(phrase, lo, hi, core, name) of the cells of phrases: starts [lo, hi) of the phrase, the fingerprints of what the cell's
        strings have in common and of all that they cover."""
        raw = np.frombuffer(b"".join(raws), np.uint8)
        sizes = np.array([len(x) for x in raws], np.int64)
        origin, starts = np.cumsum(sizes) - sizes, sizes - self.length + 1
        first = -trigger // width
        count = (starts - 1 - trigger) // width - first + 1
        phrase = np.repeat(np.arange(len(raws)), count)
        j = first[phrase] + np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count)
        low = trigger[phrase] + j * width  # of the whole cell, which may reach beyond the phrase
        lo, hi = np.maximum(0, low), np.minimum(starts[phrase], low + width)
        sa, sb, o = self.a.sums(raw), self.b.sums(raw), origin[phrase]
        with np.errstate(over="ignore"):
            place = j.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            cut = (lo - low).astype(np.uint64) * np.uint64(width + 1) + (hi - low).astype(np.uint64)
        core = self.a.span(sa, o + low + width - 1, o + low + self.length) ^ place
        name = self.b.span(sb, o + lo, o + hi + self.length - 1) ^ cut
        return phrase, lo, hi, core, name


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def _parse(texts: DataFrame, length: int) -> DataFrame:
    """(k, t) -> (seed, k, start, size, m, trigger, name): the phrases of all texts."""
    names = ["seed", "k", "start", "size", "m", "trigger", "name"]

    def run(batches):
        parser = Parser(length)
        for batch in batches:
            keys, parts, owner, bytes_ = batch.column(0), [], [], 0

            def close():
                begin, size, count, trigger, seed, name = (np.concatenate(x) for x in zip(*parts))
                small = [pa.array(x.astype(np.int32)) for x in (begin, size, count, trigger)]
                return pa.RecordBatch.from_arrays([_signed(seed), keys.take(pa.array(owner, pa.int64())), *small, _signed(name)], names=names)

            for i, t in enumerate(batch.column(1)):
                raw = _bytes(t.as_py())
                for found in parser.phrases(raw):
                    parts.append(found)
                    owner += [i] * len(found[0])
                bytes_ += len(raw)
                if parts and bytes_ > SLAB:  # bounds the arrays in hand
                    yield close()
                    parts, owner, bytes_ = [], [], 0
            if parts:
                yield close()

    return texts.mapInArrow(run, "seed long, k binary, start int, size int, m int, trigger int, name long")


def _cells(phrases: DataFrame, length: int, width: int) -> DataFrame:
    """(pid, n, at, to, core, name): the cells of phrases (pid, n, base, trigger, raw); ``base`` is the first start within the dictionary's phrase."""
    names = ["pid", "n", "at", "to", "core", "name"]

    def run(batches):
        parser = Parser(length)
        for batch in batches:
            base, trigger = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            step = max(1, SLAB // (2 * length))
            for i in range(0, batch.num_rows, step):  # bounds the arrays in hand
                part = batch.slice(i, step)
                own, lo, hi, core, name = parser.cells(part.column(4).to_pylist(), trigger[i : i + step], width)
                rows = pa.array(own)
                lo, hi = (pa.array((x + base[i : i + step][own]).astype(np.int32)) for x in (lo, hi))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), lo, hi, _signed(core), _signed(name)], names=names)

    return phrases.select("pid", "n", "base", "trigger", "raw").mapInArrow(run, "pid long, n long, at int, to int, core long, name long")


def widths(spread: int) -> list[int]:
    """Widths of the cells of each level, down to 1."""
    out = [spread]
    while out[-1] > 1:
        out.append(-(-out[-1] // BRANCH))
    return out[1:] or [1]


def _marks(dictionary: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """(pid, at, to): the repeated starts of the phrases (pid, n, trigger, raw) with n = 1; n says how often a phrase occurs."""
    marks, todo = [], dictionary.withColumn("base", F.lit(0))
    levels = widths(Parser(length).spread)
    for level, width in enumerate(levels):
        rows = scratch.write(_cells(todo, length, width), f"cells-{level}")
        cores = rows.groupBy("core").agg(F.count("*").alias("r"), F.min("name").alias("x"), F.max("name").alias("y")).where("r > 1")
        cores = scratch.write(cores.select("core", "r", (F.col("x") == F.col("y")).alias("alike")), f"cores-{level}")
        again = scratch.write(join_counted(rows, cores, ["core"], "r"), f"again-{level}")
        scratch.drop(f"cells-{level}", f"cores-{level}")
        marks.append(again.where("alike AND n = 1").select("pid", "at", "to"))
        if level == len(levels) - 1:  # a cell of one start is its core
            break
        mixed = again.where("NOT alike").drop("r", "alike")
        names = mixed.groupBy("core", "name").agg(F.sum("n").alias("n"), F.count("*").alias("r"), F.min(F.struct("pid", "at", "to")).alias("one"))
        names = scratch.write(names, f"names-{level}")
        twice = names.where("n > 1 AND r > 1").select("core", "name", "r")
        marks.append(scratch.write(join_counted(mixed.where("n = 1"), twice, ["core", "name"], "r").select("pid", "at", "to"), f"marks-{level}"))
        # Cells that occur once are cut again, and so are those they may share suffixes with.
        open_ = names.groupBy("core").agg(F.count("*").alias("r"), F.min("n").alias("least")).where("least = 1").select("core", "r")
        ahead = scratch.write(join_counted(names.drop("r"), open_, ["core"], "r").select("n", "one.*"), f"ahead-{level}")
        cut = F.expr(f"substring(raw, at + 1, to - at + {length - 1})")
        todo = ahead.join(dictionary.select("pid", "trigger", "raw"), "pid").select("pid", "n", F.col("at").alias("base"), (F.col("trigger") - F.col("at")).alias("trigger"), cut.alias("raw"))
    out = marks[0]
    for more in marks[1:]:
        out = out.unionByName(more)
    return out


def runs_of(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal removed runs for intervals of repeated starts [a, b): their strings cover [a, b + length - 1)."""
    out: list[list[int]] = []
    for a, b in sorted((a, b + length - 1) for a, b in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_texts(docs: DataFrame, scratch: Scratch, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(k, n_removed, n_spans, kept) for each distinct text with repeated strings; k is the MD5 of the text.

    All rows are parsed where they are read. Rows of equal texts give equal phrases, which are counted, not kept apart.
    """
    here = docs.where(F.octet_length(text) >= length).select(F.unhex(F.md5(F.col(text).cast("binary"))).alias("k"), F.col(text).alias("t"))
    placed = scratch.write(_parse(here, length), "phrases")
    seeds = placed.groupBy("seed").agg(F.sum("m").alias("n"), F.count("*").alias("r")).where("n > 1").select("seed", "r")
    live = scratch.write(join_counted(placed, scratch.write(seeds, "seeds"), ["seed"], "r").drop("r"), "live")
    scratch.drop("phrases", "seeds")
    names = live.groupBy("seed", "name").agg(F.sum("m").cast("long").alias("n"), F.count("*").alias("r"), F.min(F.struct("k", "start", "size", "trigger")).alias("one"))
    names = scratch.write(names.select("seed", "name", "n", "r", "one.*"), "names")
    # Suffixes matter where a seed has several phrases and one of them occurs once: the others are repeated as a whole.
    mixed = names.groupBy("seed").agg(F.count("*").alias("phrases"), F.min("n").alias("least")).where("phrases > 1 AND least = 1").select("seed", "phrases")
    mixed = join_counted(names, scratch.write(mixed, "mixed"), ["seed"], "phrases")
    # The texts with live phrases, each once: the only shuffle of texts of all documents.
    texts = here.join(live.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.min("t").alias("t"))
    texts = scratch.write(texts, "texts")
    cut = F.expr(f"substring(encode(t, 'UTF-8'), start + 1, size + {length - 1})")
    dictionary = mixed.join(texts, "k").select(F.monotonically_increasing_id().alias("pid"), "k", "start", "n", "trigger", cut.alias("raw"))
    dictionary = scratch.write(dictionary, "dictionary")  # written, so that the numbers stay
    marks = _marks(dictionary.drop("k", "start"), scratch, length)
    whole = join_counted(live, names.where("n > 1").select("seed", "name", "r"), ["seed", "name"], "r")
    whole = whole.select("k", "start", (F.col("start") + F.col("size") * F.col("m")).alias("stop"))
    parts = marks.join(dictionary.select("pid", "k", "start"), "pid").select("k", (F.col("start") + F.col("at")).alias("start"), (F.col("start") + F.col("to")).alias("stop"))
    spans = whole.unionByName(parts).groupBy("k").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))  # of one text; copies are combined before the shuffle
    spans = scratch.write(spans, "spans")
    scratch.drop("live", "names", "mixed", "dictionary", *(f"{x}-{i}" for x in ("again", "names", "marks", "ahead") for i in range(len(widths(Parser(length).spread)))))
    return _cut_out(spans.join(texts, "k"), length)


def _cut_out(rows: DataFrame, length: int) -> DataFrame:
    """(k, spans, t) -> (k, n_removed, n_spans, kept)"""

    def run(batches):
        for batch in batches:
            out = []
            for found, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, parts, last = t.encode(), [], 0
                runs = runs_of([(x["start"], x["stop"]) for x in found], length)
                for a, b in runs:
                    parts.append(raw[last:a])
                    last = b
                kept = b"".join([*parts, raw[last:]])
                out.append((len(raw) - len(kept), len(runs), kept))
            columns = list(zip(*out)) or [()] * 3
            types = (pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, x) for c, x in zip(columns, types))], names=["k", "n_removed", "n_spans", "kept"])

    return rows.select("k", "spans", "t").mapInArrow(run, "k binary, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, scratch: Scratch, *keep: str, text: str = "text", length: int = LENGTH) -> DataFrame:
    """Rows (keep, n_bytes, n_removed, n_spans, kept), one for each row of ``docs``; kept is null where nothing is removed."""
    found = repeated_texts(docs, scratch, text, length).withColumnRenamed("k", "_k")
    rows = packed(docs, keep, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("_k"))
    rows = rows.join(found, "_k", "left").select("_keep", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), "kept")
    return unpacked(rows, keep, "n_bytes", "n_removed", "n_spans", "kept")


def op6_repeated_passages(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("whole", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    found = remove_repeats(docs, Scratch(spark, "op6"), "doc_id", "whole")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.coalesce(F.sha2("kept", 256), "whole").alias("kept_sha256"))


QUERIES = {"op6_repeated_passages": op6_repeated_passages}
#: All positions' strings by their MD5: the plain way, for small tables.
ORACLES = {
    "op6_repeated_passages": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT r, i, md5_number(array_slice(b, i + 1, i + 200)) AS h FROM (SELECT r, b, unnest(range(0, octet_length(b) - 199)) AS i FROM d WHERE octet_length(b) >= 200)),
s AS (SELECT r, i FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
n AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM s),
k AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM n),
x AS (SELECT r, run, min(i) AS a, max(i) + 200 AS z FROM k GROUP BY r, run),
o AS (SELECT r, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM x GROUP BY r),
q AS (SELECT r, a AS stop, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS start FROM x
  UNION ALL SELECT r, octet_length(b), coalesce(z, 0) FROM d LEFT JOIN (SELECT r, max(z) AS z FROM x GROUP BY r) USING (r)),
t AS (SELECT r, string_agg(hex(array_slice(b, start + 1, stop)), '' ORDER BY start) AS kept FROM q JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (r) LEFT JOIN o USING (r)""",
}
