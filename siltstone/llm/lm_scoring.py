"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, word before). Classes are word endings, packed so that each has about as many training
tokens.

* *Outer softmax.* The class is predicted from hashed features of the history: the word before, the word before that (a skip feature), and
  n-grams and a skip-gram of the classes of the last three words. Weights start from the counts of (feature, class) and take one gradient step for each of
  ``ROUNDS`` parts of the training documents, dealt by the checksum of their id. A step is the sum of the gradients of all tokens of its part, in fixed
  point, so the order and the layout of the rows do not matter.
* *Inner softmax.* P(word | class, before) = q(word) * exp(weight[before, word]) / Z[before, class], with a weight for each pair of
  neighbours in the training texts. q is the word's share of its class's training tokens; the share of unknown words (Good-Turing) is spread over
  spellings by a model of bytes, last ones first, so that noise costs more than prose. As q sums to one and only words seen after ``before`` have a weight,
  Z needs those alone. The weights grow with the corpus; they are sharded by (before, class), and each shard is fitted by gradient steps
  with the curvature of each weight under a Gaussian prior.

Counts and weights are never gathered. Texts are tokenised once, into blocks of word numbers. A block asks the shards for its words' counts, and for its
pairs' weights, in packed cells of 64-bit names, one for each block and shard, and gets arrays of the same order back. Two tables of fixed size (4 and 21 MB) are
broadcast: weights of the outer softmax and the model of bytes.

Defined cases: a null or empty text is one end; a null id is the empty text for the fold and so trains; repeated rows count as
documents of their own; ties in the packing of classes go to the smaller ending; very long texts make a block of their own, whole; without training
documents every count is 0, N is 0 and the classes are uniform; an empty table gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import heapq
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, documents, n_partitions

CLASSES = 32
END_CLASS = CLASSES - 1
HASHES = 1 << 14
#: Parts of the training documents; each gives one gradient step of the outer softmax.
ROUNDS = 2
#: Share of the count-based log ratios that the outer weights start with, pseudo-tokens behind them, length of a step.
START, PSEUDO, RATE = 0.2, 5.0, 0.5
#: Precision of the inner weights' prior, and gradient steps.
PRIOR, STEPS = 0.1, 12
BATCH = 1 << 15
#: Pairs that are fitted together; a group is not cut.
SLAB = 1 << 14
#: Bytes of text of a block.
BLOCK_BYTES = 8 << 20
#: Shards at least; more where words or pairs need them.
SHARDS, SHARD_WORDS, SHARD_PAIRS = 64, 1 << 20, 3 << 19
SLICES = 64
FEATURES = 5
#: Contexts of the model of bytes: hashes of the three, the two and the one byte that follow; pseudo-counts of the shorter context.
CONTEXTS = (1 << 14, 1 << 12, 1 << 8)
LETTERS = 256 * sum(CONTEXTS)
SMOOTH = 2.0
#: Ending of the end of a text; no UTF-8 text has these bytes.
END = 0xFFFF
FIXED = 1 << 10


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def part_of(doc_id) -> int:
    """The round whose gradient a document belongs to."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) // 5 % ROUNDS


def ending(word: bytes) -> int:
    return END if not word else int.from_bytes(word[-2:], "big")


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True)


def _unpack(raw: bytes, kind, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, "zstd", asbytes=True) if n else b"", kind)


class Block:
    """Collects texts; as a row they are numbers of the block's own words, in the order of appearance; word 0 is the end."""

    def __init__(self):
        self.ids, self.held, self.part, self.texts, self.bytes = [], [], [], [], 0

    def add(self, ids: list, texts: pa.Array, n_bytes: int) -> None:
        self.ids += ids
        self.held += map(held_out, ids)
        self.part += map(part_of, ids)
        self.texts.append(texts)
        self.bytes += n_bytes

    def row(self) -> dict:
        texts = pc.ascii_lower(pc.fill_null(pa.concat_arrays(self.texts), ""))
        split = pc.ascii_split_whitespace(texts)  # with empty words at the borders of a text
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), pc.list_value_length(split).to_numpy())
        split = pa.concat_arrays([pa.array([""], texts.type), split.flatten()])
        numbered = split.dictionary_encode()
        del split
        found = numbered.indices.to_numpy()[1:]
        lengths = np.bincount(doc[found > 0], minlength=len(texts)) + 1
        codes, inside = np.zeros(lengths.sum(), np.int32), np.ones(lengths.sum(), bool)
        inside[np.cumsum(lengths) - 1] = False
        codes[inside] = found[found > 0]
        of_block = pa.LargeListArray.from_arrays(pa.array([1, len(numbered.dictionary)], pa.int64()), numbered.dictionary)
        words = pc.binary_join(of_block, pa.scalar("\n", texts.type))[0].as_buffer()
        return {
            "ids": self.ids, "held": self.held, "part": self.part, "lengths": lengths.tolist(), "codes": _pack(codes),
            "words": pa.compress(words, "zstd", asbytes=True), "n_bytes": words.size, "n_words": len(numbered.dictionary),
        }


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, a place of each, which of them each key is); cheaper than np.unique, whose sort is stable."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    keys, first = keys[new], order[new]
    number, which = np.cumsum(new), np.empty(len(new), np.int64)
    number -= 1
    which[order] = number
    return keys, first, which


_BLOCK = {
    "held": pa.list_(pa.bool_()), "part": pa.list_(pa.int32()), "lengths": pa.list_(pa.int64()), "codes": pa.binary(), "words": pa.binary(), "n_bytes": pa.int64(), "n_words": pa.int64(),
}
_BLOCK_SQL = "held array<boolean>, part array<int>, lengths array<long>, codes binary, words binary, n_bytes long, n_words long"


def tokenised(docs: DataFrame, ident: str, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each block of documents."""
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        task, n, block, id_type = TaskContext.get().partitionId(), 0, Block(), None

        def close():
            row = block.row()
            columns = [pa.array([f"{task}-{n}"]), pa.array([row["ids"]], pa.list_(id_type)), *(pa.array([row[k]], t) for k, t in _BLOCK.items())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", *_BLOCK])

        for batch in batches:
            id_type = batch.schema.types[0]
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_string())
            total = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()))
            at = 0
            while at < len(ids):  # up to the text that fills the block
                to = min(len(ids), max(at + 1, int(np.searchsorted(total, total[at] + block_bytes - block.bytes))))
                block.add(ids[at:to], texts.slice(at, to - at), int(total[to] - total[at]))
                at = to
                if block.bytes >= block_bytes:
                    yield close()
                    n, block = n + 1, Block()
        if block.ids:
            yield close()
        pa.default_memory_pool().release_unused()  # the worker lives on

    return docs.select(ident, text).mapInArrow(run, f"block string, ids array<{kind}>, {_BLOCK_SQL}")


class Tokens:
    """A block's arrays: codes, documents and places of its tokens; names and endings of its words. What a step does not ask for is not made."""

    def __init__(self, row: dict):
        self.lengths = np.array(row["lengths"], np.int64)
        self.codes = _unpack(row["codes"], np.int32, int(self.lengths.sum()))
        self.held, self.part = np.array(row["held"], bool), np.array(row["part"], np.int32)
        raw = pa.decompress(row["words"], row["n_bytes"], "zstd", asbytes=True) if row["n_bytes"] else b""
        self.words = [b"", *(raw.split(b"\n") if raw else [])]

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    @cached_property
    def place(self) -> np.ndarray:
        return np.arange(len(self.codes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)

    @cached_property
    def trains(self) -> np.ndarray:
        return ~self.held[self.doc]

    @cached_property
    def names(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))

    @cached_property
    def hashes(self) -> np.ndarray:
        return (self.names >> np.uint64(32)).astype(np.uint32)

    @cached_property
    def endings(self) -> np.ndarray:
        return endings(self.words)

    @cached_property
    def counts(self) -> np.ndarray:
        return np.bincount(self.codes[self.trains], minlength=len(self.words)).astype(np.int64)

    def pairs(self):
        """(before, code, which pair each token is, -1 for ends, training count) of the block's distinct pairs of neighbours; a text's first word comes after word 0."""
        before = np.zeros(len(self.codes), np.int64)
        before[1:] = self.codes[:-1]
        before[self.place == 0] = 0
        inside = np.flatnonzero(self.codes)
        keys, _, which = distinct(before[inside] * len(self.words) + self.codes[inside])
        of_token = np.full(len(self.codes), -1, np.int64)
        of_token[inside] = which
        n = np.bincount(which[self.trains[inside]], minlength=len(keys)).astype(np.int32)
        return keys // len(self.words), keys % len(self.words), of_token, n


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words but the end, each after a line feed, three at the end; first place of each word; word of each place)."""
    raw = np.frombuffer(b"\n" + b"\n".join(words[1:]) + b"\n\n\n", np.uint8)
    return raw, np.flatnonzero(raw[:-3] == 10)[: len(words) - 1] + 1, np.cumsum(raw == 10)


def endings(words: list[bytes]) -> np.ndarray:
    out = np.full(len(words), END, np.uint16)
    if len(words) > 1:
        raw, first, _ = _letters(words)
        last = np.append(first[1:] - 2, len(raw) - 4)
        out[1:] = raw[last] + np.where(last > first, raw[last - 1].astype(np.uint16) * 256, 0)
    return out


def spelling(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, cells) of each byte that a word is spelled with, last ones first and a line feed where it begins; the ending is not among them.
    Cells are (context, byte) for the three, the two and the one byte that follow; a line feed stands behind the word."""
    if len(words) < 2:
        return np.zeros(0, np.int64), np.zeros((len(CONTEXTS), 0), np.int64)
    raw, _, word = _letters(words)
    here, one, two, three = raw[:-3], raw[1:-2], raw[2:-1], raw[3:]
    at = np.flatnonzero((one != 10) & (two != 10))
    after = (one[at].astype(np.uint32) << np.uint32(16)) + (two[at].astype(np.uint32) << np.uint32(8)) + three[at]
    with np.errstate(over="ignore"):
        contexts = [(x * np.uint32(2654435761)) >> np.uint32(33 - size.bit_length()) for x, size in zip((after, after >> np.uint32(8)), CONTEXTS)]
    return word[at + 1], np.stack([x.astype(np.int64) * 256 + here[at] for x in (*contexts, one[at])])


def spellings(words: list[bytes], step: int = 1 << 15):
    """(first word, its and the next words' ``spelling``), which bounds the tables in hand; the words are without the end."""
    for at in range(0, len(words), step):
        word, cells = spelling([b"", *words[at : at + step]])
        yield at, word - 1, cells


class Letters:
    """The model of bytes: each context's counts, smoothed by the shorter context's."""

    def __init__(self, counts: np.ndarray):
        cuts = 256 * np.cumsum(CONTEXTS)[:-1]
        self.counts = [x.astype(np.float32) for x in np.split(counts, cuts)]
        self.totals = [x.reshape(-1, 256).sum(axis=1) for x in self.counts]
        single = self.counts[-1].reshape(256, 256).sum(axis=0)
        self.alone = (single + 0.5) / (single.sum() + 128.0)

    def log(self, cells: np.ndarray) -> np.ndarray:
        p = self.alone[cells[-1] & 255]
        for n, total, cell in list(zip(self.counts, self.totals, cells))[::-1]:
            p = (n[cell] + SMOOTH * p) / (total[cell >> 8] + SMOOTH)
        return np.log(p)


def _rows_of(x: np.ndarray, factor: int) -> np.ndarray:
    """Whole numbers to rows of the table of weights."""
    with np.errstate(over="ignore"):
        return ((x.astype(np.uint32) * np.uint32(factor)) >> np.uint32(33 - HASHES.bit_length())).astype(np.uint16)


_PAIRED, _SKIPPED, _TRIPLE = (_rows_of(np.arange(1, n + 1), k) for n, k in ((CLASSES**2, 3266489917), (CLASSES**2, 668265263), (CLASSES**3, 374761393)))


def word_rows(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of words as the word before, and as the one before that."""
    return _rows_of(hashes, 2654435761), _rows_of(hashes, 2246822519)


def history(one: np.ndarray, two: np.ndarray, classes: np.ndarray, starts: np.ndarray, end: tuple[int, int]) -> np.ndarray:
    """Hashed features (FEATURES x tokens) of each token's history, from the tokens' ``word_rows`` and classes and the first tokens of documents;
    before a document stand ends, whose rows are ``end``."""

    def back(x, k, first):
        out = np.empty_like(x)
        out[k:] = x[: len(x) - k]
        out[:k] = first
        for j in range(k):
            at = starts + j
            out[at[at < len(x)]] = first
        return out

    c = classes.astype(np.uint16)
    c1, c2, c3 = (back(c, k, END_CLASS) for k in (1, 2, 3))
    pair = c1 * np.uint16(CLASSES) + c2
    return np.stack([back(one, 1, end[0]), back(two, 2, end[1]), _PAIRED[pair], _SKIPPED[c1 * np.uint16(CLASSES) + c3], _TRIPLE[pair.astype(np.int32) * CLASSES + c3]])


def features(block: Tokens, classes: np.ndarray, docs: np.ndarray | None = None, step: int = 1 << 16):
    """(slice of tokens, their features, their classes), which bounds the table in hand; of some documents only, if a mask is given."""
    of_word, codes, place = classes[block.endings], block.codes, block.place
    if docs is not None:
        inside = docs[block.doc]
        codes, place = codes[inside], place[inside]
    one, two = word_rows(block.hashes)
    starts = np.flatnonzero(place == 0)
    for at in range(0, len(codes), step):
        begin = max(0, at - 3)
        part = codes[begin : at + step]
        k = of_word[part]
        first = starts[np.searchsorted(starts, begin) : np.searchsorted(starts, at + step)] - begin
        f = history(one[part], two[part], k, first, (one[0], two[0]))
        yield slice(at, at + step), f[:, at - begin :], k[at - begin :].astype(np.int32)


def _logits(w: np.ndarray, bias: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Weights start below START * log of all tokens and move by ROUNDS at most, so sums stay far from the range of exp; clipped to be sure."""
    rows = f.astype(np.intp)
    out = w.take(rows[0], axis=0)
    for k in range(1, FEATURES):
        out += w.take(rows[k], axis=0)
    out += bias
    return np.clip(out, -80.0, 80.0, out=out)


def add_gradient(total: np.ndarray, w: np.ndarray, bias: np.ndarray, f: np.ndarray, y: np.ndarray) -> None:
    """Adds the gradient of the log probability of the classes y."""
    sums, ones = np.zeros((CLASSES, HASHES)), np.ones(CLASSES, np.float32)
    for at in range(0, len(y), BATCH):
        fb, yb = f[:, at : at + BATCH], y[at : at + BATCH]
        p = np.exp(_logits(w, bias, fb))
        p /= (p @ ones)[:, None]
        p[np.arange(len(yb)), yb] -= 1.0
        of_class = np.ascontiguousarray(p.T, dtype=np.float64)
        for rows in fb.astype(np.intp):
            for k in range(CLASSES):
                sums[k] += np.bincount(rows, of_class[k], HASHES)
    total -= sums.T


def _rows(kinds: dict, *rows: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))


def _wrap(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "big") + _pack(x)


def _unwrap(raw: bytes) -> np.ndarray:
    return _unpack(raw[8:], np.int64, int.from_bytes(raw[:8], "big"))


_SLICE = {"slice": pa.int32(), "salt": pa.int32(), "data": pa.binary()}


def _sliced(table: np.ndarray, first: int = 0):
    """The rows of a table of whole numbers, in SLICES."""
    from pyspark import TaskContext

    salt = TaskContext.get().partitionId() % 32
    return _rows(_SLICE, *((first + i, salt, _wrap(x)) for i, x in enumerate(np.split(table.astype(np.int64).ravel(), SLICES))))


def summed(parts: DataFrame, tables: int = 1) -> list[np.ndarray]:
    """The sums of the tables that tasks gave by ``_sliced``: two levels, SLICES rows of fixed size for each table to the driver."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                sums[s] = sums[s] + _unwrap(raw) if s in sums else _unwrap(raw)
        yield _rows(_SLICE, *((s, 0, _wrap(x)) for s, x in sums.items()))

    schema = "slice int, salt int, data binary"
    got = {r.slice: r.data for r in parts.repartition("slice", "salt").mapInArrow(add, schema).repartition("slice").mapInArrow(add, schema).collect()}
    whole = lambda i: np.concatenate([_unwrap(got[s]) for s in range(i * SLICES, (i + 1) * SLICES)])
    return [whole(i) if got else None for i in range(tables)]


def _short(x: np.ndarray, parts: int) -> np.ndarray:
    """Logarithms as whole numbers of such parts."""
    most = 32767 / parts
    return np.rint(np.clip(x, -most, most) * parts).astype(np.int16)


def _shard(names: np.ndarray, shards: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _dealt(shard: np.ndarray):
    """(order by shard, [(shard, part of that order)])"""
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")  # 16 bits are sorted by counting
    cuts = np.append(np.flatnonzero(np.diff(shard[order], prepend=-1)), len(order))
    return order, [(int(shard[order[a]]), slice(a, b)) for a, b in zip(cuts, cuts[1:])]


_COUNT = {"block": pa.string(), "shard": pa.int32(), "data": pa.binary()}


def _word_counts(blocks: DataFrame, shards: int) -> DataFrame:
    """(block, shard, data): training counts of the block's words of a shard, in the block's order; with a null block the shard's
    (ending, tokens, words, words seen once)."""
    kinds = {"shard": pa.int32(), "block": pa.string(), "names": pa.binary(), "counts": pa.binary(), "endings": pa.binary()}

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Tokens(row)
                order, parts = _dealt(_shard(block.names, shards))
                for s, at in parts:
                    at = order[at]
                    yield _rows(kinds, (s, row["block"], block.names[at].tobytes(), block.counts[at].astype(np.int32).tobytes(), block.endings[at].tobytes()))

    def answer(table: pa.Table) -> pa.Table:
        col = lambda k, kind: [np.frombuffer(x, kind) for x in table.column(k).to_pylist()]
        names, counts, ends = col("names", np.uint64), col("counts", np.int32), col("endings", np.uint16)
        shard = table.column("shard")[0].as_py()
        _, first, which = distinct(np.concatenate(names))
        total = np.bincount(which, np.concatenate(counts)).astype(np.int64)
        of = np.concatenate(ends)[first]
        known = total > 0
        stats = [np.bincount(of[known], x, 1 << 16).astype(np.int64) for x in (total[known], np.ones(known.sum()), total[known] == 1)]
        there = np.flatnonzero(stats[1])
        rows = [(None, shard, np.stack([there, *(x[there] for x in stats)]).tobytes())]
        for block, back in zip(table.column("block").to_pylist(), np.split(total[which], np.cumsum([len(x) for x in names])[:-1])):
            rows.append((block, shard, _pack(back)))
        return pa.Table.from_batches([_rows(_COUNT, *rows)])

    asked = blocks.mapInArrow(ask, "shard int, block string, names binary, counts binary, endings binary")
    return asked.groupBy("shard").applyInArrow(answer, "block string, shard int, data binary")


def _ending_sums(stats: DataFrame) -> np.ndarray:
    """(tokens, words, words seen once) x ending: 65,536 rows at most reach the driver."""

    def run(batches):
        total = np.zeros((3, 1 << 16), np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                at, *x = np.frombuffer(raw, np.int64).reshape(4, -1)
                total[:, at] += x
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x[at]) for x in total)], names=["ending", "a", "b", "c"])

    got = stats.mapInArrow(run, "ending long, a long, b long, c long").groupBy("ending").agg(F.sum("a"), F.sum("b"), F.sum("c")).collect()
    out = np.zeros((3, 1 << 16), np.int64)
    for r in got:
        out[:, r[0]] = r[1:]
    return out


class Endings:
    """Classes of the endings, packed by training tokens, with the shares that follow from them."""

    def __init__(self, sums: np.ndarray):
        tokens, words, once = sums
        self.n, self.v = int(tokens.sum()), int(words.sum())
        self.classes = (np.arange(1 << 16) % (CLASSES - 1)).astype(np.uint8)
        heap = [(0, k) for k in range(CLASSES - 1)]
        for e in np.argsort(-tokens, kind="stable").tolist():
            if tokens[e] and e != END:
                load, k = heapq.heappop(heap)
                self.classes[e] = k
                heapq.heappush(heap, (load + int(tokens[e]), k))
        self.classes[END] = END_CLASS
        per = lambda x: np.bincount(self.classes, x, CLASSES)
        self.tokens = per(tokens)
        self.bias = np.log((self.tokens + 0.5) / (self.n + 0.5 * CLASSES)).astype(np.float32)
        self.unknown = (per(once) + 0.5) / (self.tokens + 1.0)
        self.unknown[END_CLASS] = 0.0
        self.spread = (once + 0.5) / per(once + 0.5)[self.classes]  # of a class's unknown words over its endings

    def shares(self, block: Tokens, counts: np.ndarray, letters: Letters) -> np.ndarray:
        """Logarithm of q for the words of a block, in 512ths."""
        k = self.classes[block.endings]
        spelled = np.zeros(len(block.words))
        for at, word, cells in spellings(block.words[1:]):
            if len(word):
                sums = np.bincount(word, letters.log(cells))
                spelled[at + 1 : at + 1 + len(sums)] = sums
        known = np.where(counts > 0, counts / np.maximum(self.tokens[k], 1), 0.0) * (1 - self.unknown[k])
        with np.errstate(divide="ignore"):
            q = np.logaddexp(np.log(known), np.log(self.unknown[k] * self.spread[block.endings]) + spelled)
        q[0] = 0.0
        return np.rint(q * 512) / 512  # as the shards see it


def _pair_names(block: Tokens, before: np.ndarray, code: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """64-bit names of (word before, class)."""
    with np.errstate(over="ignore"):
        x = block.names[before] ^ (classes[block.endings[code]].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fit_pairs(group: np.ndarray, n: np.ndarray, q: np.ndarray, prior: float = PRIOR, steps: int = STEPS) -> np.ndarray:
    """log P(word | class, before) - log q(word) of pairs sorted by group (before, class), from their training counts and q.

    Gradient steps on all groups at once, from weights that give each pair its share alone. A group's curvature, a diagonal less a product, is
    undone in sums over the group.
    """
    out, starts = np.zeros(len(group)), np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(starts, len(group)))
    cuts = np.append(np.unique(starts[np.searchsorted(starts, np.arange(0, len(group), SLAB), "right") - 1]), len(group)) if len(group) else starts
    for a, b in zip(cuts, cuts[1:]):  # whole groups, whose tables stay in the cache
        here = slice(*np.searchsorted(starts, (a, b)))
        out[a:b] = _fit_slab(np.repeat(np.arange(here.stop - here.start), sizes[here]), n[a:b], q[a:b], prior, steps)
    return out


def _fit_slab(of: np.ndarray, n: np.ndarray, q: np.ndarray, prior: float, steps: int) -> np.ndarray:
    """``fit_pairs`` of groups numbered from 0. A pair that training has not seen has no weight, and a group without any has Z = 1."""
    log_z, seen = np.zeros(of[-1] + 1), np.flatnonzero(n > 0)
    if not len(seen):
        return log_z[of]
    groups, n, q = of[seen], n[seen].astype(float), q[seen]
    starts = np.flatnonzero(np.diff(groups, prepend=-1))
    number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(groups))))
    sums = lambda x: np.add.reduceat(x, starts)
    of_group, others = sums(n)[number], np.maximum(0.0, 1 - sums(q))  # words never seen in the group
    weight = np.log(n / (of_group + 1) / q)
    for _ in range(steps):
        p = q * np.exp(weight)
        p /= (others + sums(p))[number]
        mass = of_group * p
        curve = mass + prior
        alone = (n - mass - prior * weight) / curve
        share = mass / curve
        step = alone + share * (sums(p * alone) / (1 - sums(p * share)))[number]
        weight += np.clip(step, -4.0, 4.0, out=step)
    log_z[groups[starts]] = np.log(others + sums(q * np.exp(weight)))
    out = -log_z[of]
    out[seen] += weight
    return out


_PAIR = {"shard": pa.int32(), "block": pa.string(), "groups": pa.binary(), "words": pa.binary(), "q": pa.binary(), "counts": pa.binary()}


def _pair_weights(blocks: DataFrame, shards: int, ends, letters, prior: float) -> DataFrame:
    """(block, shard, data): for a block's pairs of a shard, in the block's order, log P(word | class, before) - log q(word), in 1024ths."""

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Tokens(row)
                q = _short(ends.value.shares(block, _unpack(row["c"], np.int64, len(block.words)), letters.value), 512)
                before, code, _, n = block.pairs()
                names = _pair_names(block, before, code, ends.value.classes)
                order, parts = _dealt(_shard(names, shards))
                low = np.uint64(0xFFFFFFFF)
                for s, at in parts:
                    at = order[at]
                    cell = (names[at] & low).astype(np.uint32), (block.names[code[at]] & low).astype(np.uint32), q[code[at]]
                    yield _rows(_PAIR, (s, row["block"], *(x.tobytes() for x in cell), _pack(n[at])))

    def answer(table: pa.Table) -> pa.Table:
        col = lambda k, kind: [np.frombuffer(x, kind) for x in table.column(k).to_pylist()]
        groups, words = col("groups", np.uint32), np.concatenate(col("words", np.uint32))
        keys = np.concatenate(groups).astype(np.uint64) << np.uint64(32) | words
        keys, first, which = distinct(keys)
        counts = [_unpack(x, np.int32, len(g)) for x, g in zip(table.column("counts").to_pylist(), groups)]
        n = np.bincount(which, np.concatenate(counts))
        q = np.exp(np.concatenate(col("q", np.int16))[first] / 512)
        found = _short(fit_pairs((keys >> np.uint64(32)).astype(np.int64), n, q, prior), 1024)
        shard = table.column("shard")[0].as_py()
        back = np.split(found[which], np.cumsum([len(x) for x in groups])[:-1])
        return pa.Table.from_batches([_rows(_COUNT, *((b, shard, _pack(x)) for b, x in zip(table.column("block").to_pylist(), back)))])

    asked = blocks.mapInArrow(ask, "shard int, block string, groups binary, words binary, q binary, counts binary")
    return asked.groupBy("shard").applyInArrow(answer, "block string, shard int, data binary")


def _answers(table: pa.Table, order: np.ndarray, parts, kind) -> np.ndarray:
    """What the shards said, in the block's own order."""
    data = dict(zip(table.column("shard").to_pylist(), table.column("data").to_pylist()))
    out = np.empty(len(order), kind)
    for s, at in parts:
        out[order[at]] = _unpack(data[s], kind, at.stop - at.start)
    return out


def _counted(blocks: DataFrame, counts: DataFrame, shards: int, parts: int) -> DataFrame:
    """The blocks with c, the training counts of their words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Tokens(left.to_pylist()[0])
        order, cells = _dealt(_shard(block.names, shards))
        return left.append_column("c", pa.array([_pack(_answers(right, order, cells, np.int64))], pa.binary()))

    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in blocks.schema.fields)
    return _met(blocks, counts, parts).applyInArrow(run, f"{kinds}, c binary")


def _met(blocks: DataFrame, answers: DataFrame, parts: int):
    """Blocks with the answers to them, in so many tasks."""
    answers = answers.withColumnRenamed("block", "of")
    return blocks.repartition(parts, "block").groupBy("block").cogroup(answers.repartition(parts, "of").groupBy("of"))


def _first_counts(blocks: DataFrame, ends, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(training counts of feature and class, counts of the model of bytes)."""

    def run(batches):
        seen, cells, first = np.zeros(HASHES * CLASSES, np.int64), np.zeros(LETTERS, np.int64), 256 * np.cumsum((0, *CONTEXTS[:-1]))
        for batch in batches:
            for row in batch.to_pylist():
                block = Tokens(row)
                for _, f, y in features(block, ends.value.classes, ~block.held, 1 << 18):
                    for k in range(FEATURES):
                        seen += np.bincount(f[k].astype(np.int32) * CLASSES + y, minlength=HASHES * CLASSES)
                once = np.flatnonzero((_unpack(row["c"], np.int64, len(block.words)) == 1) & (block.counts == 1))
                for _, _, spelled in spellings([block.words[i] for i in once]):
                    cells += np.bincount((spelled + first[:, None]).ravel(), minlength=LETTERS)
        yield _sliced(seen)
        yield _sliced(cells, SLICES)

    tables = scratch.write(blocks.mapInArrow(run, "slice int, salt int, data binary"), "first-counts")
    seen, cells = summed(tables, 2)
    scratch.drop("first-counts")
    if seen is None:  # an empty table
        return np.zeros((HASHES, CLASSES), np.int64), np.zeros(LETTERS, np.int64)
    return seen.reshape(HASHES, CLASSES), cells


def _gradient(blocks: DataFrame, turn: int, ends, weights: np.ndarray, scratch: Scratch) -> np.ndarray:
    """The sum of the gradients of the training tokens of a part of the documents."""
    shared = blocks.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        total = np.zeros((HASHES, CLASSES), np.float32)
        whole = np.zeros((HASHES, CLASSES), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                block = Tokens(row)
                total[:] = 0
                for _, f, y in features(block, ends.value.classes, ~block.held & (block.part == turn)):
                    add_gradient(total, shared.value, ends.value.bias, f, y)
                whole += np.rint(total.astype(float) * FIXED).astype(np.int64)
        yield _sliced(whole)

    table = scratch.write(blocks.mapInArrow(run, "slice int, salt int, data binary"), f"gradient-{turn}")
    got = summed(table)[0]
    scratch.drop(f"gradient-{turn}")
    shared.unpersist()
    return np.zeros((HASHES, CLASSES)) if got is None else got.reshape(HASHES, CLASSES) / FIXED


def fit_classes(seen: np.ndarray, ends: Endings, gradient, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the outer softmax: log ratios of the counts, then a step along each gradient(turn, weights)."""
    share = np.exp(ends.bias.astype(float))
    share /= share.sum()
    of_row = seen.sum(axis=1, keepdims=True)
    weights = START * np.log((seen / share + PSEUDO) / (of_row + PSEUDO))
    for turn in range(rounds):
        step = gradient(turn, weights.astype(np.float32)) / (seen / rounds + of_row * share / rounds + PSEUDO)
        weights += np.clip(RATE * step, -1.0, 1.0)
    return weights.astype(np.float32)


def score(docs: DataFrame, scratch: Scratch, ident: str, text: str = "text", rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES, prior: float = PRIOR) -> DataFrame:
    """Rows (ident, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of ``docs``."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    blocks = scratch.write(tokenised(docs, ident, text, block_bytes), "blocks")
    whole = blocks.agg(F.sum("n_words").alias("words"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens"), F.count("*").alias("blocks")).first()
    shards, pair_shards = max(SHARDS, -(-(whole.words or 0) // SHARD_WORDS)), max(SHARDS, -(-(whole.tokens or 0) // SHARD_PAIRS))
    parts = n_partitions(spark, -(-whole.blocks // 2))
    counts = scratch.write(_word_counts(blocks, shards), "counts")
    model = Endings(_ending_sums(counts.where("block IS NULL").select("data")))
    ends = share(model)
    counted = scratch.write(_counted(blocks, counts.where("block IS NOT NULL"), shards, parts), "counted")
    scratch.drop("blocks", "counts")
    seen, cells = _first_counts(counted, ends, scratch)
    letters = share(Letters(cells))
    weights = share(fit_classes(seen, model, lambda turn, w: _gradient(counted, turn, ends, w, scratch), rounds))
    pairs = scratch.write(_pair_weights(counted, pair_shards, ends, letters, prior), "pairs")
    names = [ident, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = f"`{ident}` {docs.schema[ident].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, e = left.to_pylist()[0], ends.value
        block = Tokens(row)
        c = _unpack(row["c"], np.int64, len(block.words))
        base = np.log10((c + 0.5) / (e.n + 0.5 * (e.v + 1)))
        before, code, of_token, _ = block.pairs()
        order, cells = _dealt(_shard(_pair_names(block, before, code, e.classes), pair_shards))
        gain = _answers(right, order, cells, np.int16) / 1024
        lp = e.shares(block, c, letters.value)[block.codes]
        inside = of_token >= 0
        lp[inside] += gain[of_token[inside]]
        for at, f, y in features(block, e.classes, step=1 << 13):
            logits = _logits(weights.value, e.bias, f)
            lp[at] += logits[np.arange(len(y)), y] - np.log(np.exp(logits) @ np.ones(CLASSES, np.float32))
        total = lambda x: np.bincount(block.doc, x, len(block.lengths))
        columns = [
            left.column("ids").combine_chunks().flatten(), pa.array(block.held), pa.array(block.lengths), pa.array(total(c[block.codes] > 0).astype(np.int64)),
            pa.array(np.full(len(block.lengths), e.n)), pa.array(total(base[block.codes])), pa.array(total(lp) / np.log(10.0)),
        ]
        return pa.Table.from_arrays(columns, names=names)

    return _met(counted, pairs, parts).applyInArrow(run, schema)


def op2_lm_scoring(spark, sf_dir):
    return score(documents(spark, sf_dir), Scratch(spark, "op2"), "doc_id")


QUERIES = {"op2_lm_scoring": op2_lm_scoring}
ORACLES: dict[str, str] = {}
