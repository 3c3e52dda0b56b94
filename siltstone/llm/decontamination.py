"""Benchmark decontamination by template canonicalisation.

Words of documents and benchmark items become templates: numbers, units and names (capitalised inside a sentence) turn into typed
placeholders, all else into lower case. Windows of ``WINDOW`` template words are hashed and joined with the benchmark's windows. A hit
carries the words behind the placeholders; hits of an item on one diagonal (document place minus item place) form runs, and a run
counts as contamination if it spans ``SPAN`` words or the whole item, and if its slots are consistent: the same original value always has
the same new value. So re-parameterised questions are caught as well as verbatim passages, whatever their case.

Three templates are made of each text: without name placeholders, with them, and with capitalised words at the start of a sentence as names
too, for copies that change case, names, and names that begin a sentence.
A window needs one plain word, that of an item shorter than a window more than half or ``LITERAL``. Where a diagonal's windows all have fewer than
``LITERAL`` plain words, a run with changed slots must hold as many plain words in all, or all of the item's, so that tables of numbers are not taken
for questions. Windows of the benchmark that are short of plain words are posted by their original words too, numbers kept, so verbatim
copies always meet.

The benchmark is broadcast up to ``MAX_BROADCAST`` windows (a checked count); a larger one is joined by a shuffle on the window hash, in which
a hot window is split by adaptive execution. Documents are read whole; only hits leave a row.

Defined cases: null or empty texts have no windows and are clean; an empty benchmark leaves all clean; items shorter than a window are one
window of their own length; items of fewer than ``LITERAL`` words count where their exact whole text stands, with case and punctuation, between
word boundaries; items without a word are left out; repeated rows repeat in the result; of runs of one length that with unchanged slots counts (ties); very long
texts are read whole; ids of items that are not whole numbers are given as texts; a kept column with the name of one of the operator's own gives way to it.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from siltstone.llm.common import documents, packed, slices, unpacked, unused

WINDOW = 8
LITERAL = 5
SPAN = 13
MAX_BROADCAST = 2_000_000
#: Unit words.
UNITS = frozenset("mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds lb ounce ounces oz ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars usd euro euros cent cents percent kmh mph".split())
NUMBER, UNIT, NAME = 4, 8, 12
#: Characters of the texts that are coded together.
SLAB = 2_000_000
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?:\n]")
_NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())


def templates(text: str | None) -> tuple[list[str], list[str], list[str], list[str]]:
    """(words, template without names, with names, with names at the start of sentences too) of a whole text."""
    words, plain, named, initial, start = [], [], [], [], True
    for token in _TOKEN.findall(text or ""):
        if token in ".!?:\n":
            start = True
            continue
        low = token.lower()
        words.append(low)
        if token[0].isdigit() or low in _NUMBERS:
            plain.append("\x01n")
            named.append("\x01n")
            initial.append("\x01n")
        elif low in UNITS and plain and plain[-1] == "\x01n":
            plain.append("\x01u")
            named.append("\x01u")
            initial.append("\x01u")
        else:
            plain.append(low)
            named.append("\x01p" if not start and token[0].isupper() else low)
            initial.append("\x01p" if token[0].isupper() else low)
        start = False
    return words, plain, named, initial


def _codes(template: list[str]) -> np.ndarray:
    """64-bit codes of template words; those of placeholders are below 16."""
    fixed = {"\x01n": NUMBER, "\x01u": UNIT, "\x01p": NAME}
    return np.array([fixed.get(w) or _code(w) for w in template], np.uint64)


def _code(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) & ~15 | 16


def _hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all windows; 0 where a window has too few plain words to be looked up."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total ^= codes[k : k + n]
            total *= np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
    total[_plain_words(codes, size) < (1 if size == WINDOW else _enough(size))] = 0
    return total


def _plain_words(codes: np.ndarray, size: int) -> np.ndarray:
    """Plain words of all windows."""
    slots = np.concatenate([[0], np.cumsum(codes < 16)])
    return size - (slots[size:] - slots[:-size])


def _enough(size: int) -> int:
    """Plain words with which a window needs no other key."""
    return min(LITERAL, size // 2 + 1)


def _literal(words: list[str]) -> np.ndarray:
    """64-bit codes of original words; none is a placeholder's."""
    return np.array([_code(w) for w in words], np.uint64)


def _item_windows(words: list[str], forms: list[list[str]]):
    """(kind, hash, place, whether it has enough plain words) of an item's windows; the last kind is the original words."""
    size = min(WINDOW, len(words))
    short = np.full(max(0, len(words) - size + 1), len(words) < LITERAL)
    if len(words) >= LITERAL:
        for kind, template in enumerate(forms):
            codes = _codes(template)
            strong = _plain_words(codes, size) >= _enough(size)
            yield from ((kind, h ^ size, i, bool(strong[i])) for i, h in enumerate(_hashes(codes, size).tolist()) if h)
            if kind == 0:
                short = ~strong
                short[0] |= words[0] in UNITS  # which is no unit here, but is after a number
    literal = _hashes(_literal(words), size).tolist()
    yield from ((len(forms), literal[i] ^ size, i, True) for i in np.flatnonzero(short).tolist())


def _stands(item: str, text: str) -> bool:
    """Whether an item's exact text stands in a text between word boundaries; white space counts as one space."""
    item = r"\s+".join(re.escape(x) for x in item.split())
    return re.search(rf"(?<!\w){item}(?!\w)" if item[:1].isalnum() and item[-1:].isalnum() else rf"(?<!\w){item}" if item[:1].isalnum() else item, text) is not None


class LiteralCoder(dict):
    """Token -> code of the original word, 0 for the end of a sentence."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = n = 0 if token in ".!?:\n" else _code(token.lower())
        return n


class Coder(dict):
    """Token -> (code of the plain template, flags): 0 for the end of a sentence; bit 0 a capital, bit 1 a unit word."""

    def __missing__(self, token: str) -> int:
        low = token.lower()
        if token in ".!?:\n":
            n = 0
        elif token[0].isdigit() or low in _NUMBERS:
            n = NUMBER
        else:
            n = _code(low) | (1 if token[0].isupper() else 0) | (2 if low in UNITS else 0)
        if len(self) > 500_000:
            self.clear()
        self[token] = n
        return n


class Benchmark:
    """Windows of all items: hash -> [(item, place)], with the items' templates."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, self.at, self.sizes, self.literal_sizes = {}, defaultdict(list), set(), set()
        for item, text in items:
            words, *forms = templates(text)
            if not words:
                continue
            need = min(LITERAL, sum(w[0] != "\x01" for w in forms[0]))
            rows = [self.items.setdefault((item, kind), []) for kind in range(len(forms) + 1)]
            for row, template in zip(rows, [*forms, words]):
                row.append((words, template, need, text if len(words) < LITERAL else None))
            for kind, h, i, strong in _item_windows(words, forms):
                (self.literal_sizes if kind == len(forms) else self.sizes).add(min(WINDOW, len(words)))
                self.at[h].append(((item, kind), len(rows[kind]) - 1, i, strong))
        self.keys = np.array(sorted(self.at), np.uint64)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.keys >> np.uint64(44)] = True
        self.literal = LiteralCoder()

    def hits(self, codes: np.ndarray, size: int) -> np.ndarray:
        """Places of windows that the benchmark has too."""
        hashes = _hashes(codes, size) ^ np.uint64(size)
        maybe = np.flatnonzero(self.bits[hashes >> np.uint64(44)])
        return maybe[np.isin(hashes[maybe], self.keys)]

    def candidates(self, texts: list[str | None], coder: Coder) -> list[int]:
        """Indices of the texts with a window of the benchmark."""
        tokens = [_TOKEN.findall(t) if t else [] for t in texts]
        raw = np.array([coder[w] for t in tokens for w in t], np.uint64)
        if not len(raw) or not len(self.keys):
            return []
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in tokens])
        words = np.flatnonzero(raw > 0)
        first = np.ones(len(raw), bool)
        first[1:] = (raw[:-1] == 0) | (doc[1:] != doc[:-1])
        capital = (raw & np.uint64(1)).astype(bool) & (raw >= 16)
        unit = (raw & np.uint64(2)).astype(bool) & (raw >= 16)
        raw, doc, capital, unit, first = raw[words], doc[words], capital[words], unit[words], first[words]
        plain = np.where(raw >= 16, raw & ~np.uint64(15) | np.uint64(16), raw)
        after = np.zeros(len(raw), bool)
        after[1:] = (raw[:-1] == NUMBER) & (doc[1:] == doc[:-1])
        plain[unit & after] = UNIT
        named, initial = plain.copy(), plain.copy()
        named[capital & ~first & (plain >= 16)] = NAME
        initial[capital & (plain >= 16)] = NAME
        found = set()
        for size in self.sizes:
            for codes in (plain, named, initial):
                at = self.hits(codes, size)
                at = at[doc[at] == doc[at + size - 1]]
                found.update(doc[at].tolist())
        if self.literal_sizes:
            literal = np.array([self.literal[w] for t in tokens for w in t], np.uint64)[words]
            for size in self.literal_sizes:
                at = self.hits(literal, size)
                at = at[doc[at] == doc[at + size - 1]]
                found.update(doc[at].tolist())
        return sorted(found)

    def find(self, text: str | None) -> list[tuple[int, int, bool]]:
        """(item, words covered, whether slots changed) of each contaminating item."""
        words, *forms = templates(text)
        runs: dict[tuple, bool] = {}  # of each diagonal: whether one of its windows has enough plain words
        kinds = [*((template, _codes(template), self.sizes) for template in forms), (words, _literal(words) if self.literal_sizes else None, self.literal_sizes)]
        for kind, (_, codes, sizes) in enumerate(kinds):
            for size in sizes:
                hashes = _hashes(codes, size) ^ np.uint64(size)
                for i in self.hits(codes, size).tolist():
                    for key, k, j, strong in self.at[int(hashes[i])]:
                        if key[1] == kind:
                            runs[key, k, i - j] = runs.get((key, k, i - j), False) or strong
        best: dict[int, tuple[int, bool]] = {}
        stands: dict[str | None, bool] = {None: True}  # of each short item, looked for once and not on each diagonal
        for (key, k, shift), strong in runs.items():
            *item, need, short = self.items[key][k]
            if short not in stands:
                stands[short] = _stands(short, text)
            if not stands[short]:
                continue
            n, changed = self.run(words, kinds[key[1]][0], item, shift, 0 if strong else need)
            if n:
                before = best.get(key[0], (0, True))
                best[key[0]] = max(before, (n, changed), key=lambda x: (x[0], not x[1]))
        return sorted((item, n, changed) for item, (n, changed) in best.items())

    def run(self, words, template, item, shift, need: int = 0) -> tuple[int, bool]:
        """Longest stretch on a diagonal where the templates agree and slots are consistent; 0 if it is too short.

        A stretch with changed slots must hold ``need`` plain words, else what follows its last changed slot counts.
        """
        own_words, own = item
        best, best_changed, begin, values, last_changed = 0, False, 0, {}, -1
        plain = np.concatenate([[0], np.cumsum([w[0] != "\x01" for w in own])]).tolist()
        for j in range(len(own)):
            i = j + shift
            if not (0 <= i < len(template) and template[i] == own[j]):
                begin = j + 1
                continue
            if own[j][0] == "\x01":
                slot = own[j], own_words[j]
                value, at = values.get(slot, (words[i], j))
                if value != words[i]:
                    begin = max(begin, at + 1)  # just past the last use with the other value
                values[slot] = words[i], j
                if own_words[j] != words[i]:
                    last_changed = j
            since = begin if plain[j + 1] - plain[begin] >= need else max(begin, last_changed + 1)
            if j + 1 - since > best:
                best, best_changed = j + 1 - since, last_changed >= since
        return (best, best_changed) if best >= min(SPAN, len(own)) else (0, False)


_OWN = ("contaminated", "n_items", "items", "most_words", "reparameterised")
#: Ids of items are whole numbers, or texts.
_IDS = {"bigint": pa.int64(), "string": pa.string()}


def _columns(found: list[list[tuple[int, int, bool]]], kind: str) -> list[pa.Array]:
    values = (
        [bool(f) for f in found],
        [len(f) for f in found],
        [[x[0] for x in f] for f in found],
        [max((x[1] for x in f), default=0) for f in found],
        [any(x[2] for x in f) for f in found],
    )
    return [pa.array(v, k) for v, k in zip(values, (pa.bool_(), pa.int32(), pa.list_(_IDS[kind]), pa.int32(), pa.bool_()))]


def _slabs(texts: list[str | None]):
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > SLAB:
            yield begin, i + 1
            begin, size = i + 1, 0
    yield begin, len(texts)


def _scan(docs: DataFrame, items: list[tuple[int, str]], kind: str, *keep: str, text: str) -> DataFrame:
    rows = docs.select(*keep, F.col(text).alias(unused(keep, "_text")))
    own = f"contaminated boolean, n_items int, items array<{kind}>, most_words int, reparameterised boolean"
    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields[:-1]), own])
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        index, coder = Benchmark(shared.value), Coder()
        for b in slices(batches):
            texts = b.column(b.num_columns - 1).to_pylist()
            found: list = [[] for _ in texts]
            for lo, hi in _slabs(texts):
                for i in index.candidates(texts[lo:hi], coder):
                    found[lo + i] = index.find(texts[lo + i])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *_columns(found, kind)], names=[*b.schema.names[:-1], *_OWN])

    return rows.mapInArrow(run, schema)


def _windows(df: DataFrame, *ids: str, literal: tuple[int, ...] = ()) -> DataFrame:
    """(h, literal, ids) for each distinct window of each row: of an item, or of a text with windows of original words of the sizes
    ``literal``; the column ``literal`` has the size of such a window, else 0. The text is the last column of ``df``."""
    schema = ", ".join(["h long", "literal int", *(f"`{x.name}` {x.dataType.simpleString()}" for x in df.select(*ids).schema.fields)])

    def run(batches):
        for b in slices(batches):
            hs, kinds, at = [], [], []
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                words, *forms = templates(t)
                if len(ids) == 1:
                    got = {(int(h) ^ s, 0) for template in forms for s in range(LITERAL, WINDOW + 1) for h in _hashes(_codes(template), s) if h}
                    got |= {(int(h) ^ s, s) for s in literal for h in _hashes(_literal(words), s)}
                else:
                    got = {(h, min(WINDOW, len(words)) if kind == len(forms) else 0) for kind, h, _, _ in _item_windows(words, forms)} if words else set()
                hs += [h for h, _ in got]
                kinds += [k for _, k in got]
                at += [i] * len(got)
            rows = pa.array(at, pa.int64())
            h = pa.array(np.array(hs, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([h, pa.array(kinds, pa.int32()), *(c.take(rows) for c in b.columns[:-1])], names=["h", "literal", *b.schema.names[:-1]])

    return df.mapInArrow(run, schema)


def _joined(docs: DataFrame, items: DataFrame, kind: str, *keep: str, text: str) -> DataFrame:
    """The same by a shuffle join on window hashes, for a benchmark of any size. A text's result depends on the text alone."""
    texts = docs.where(F.col(text).isNotNull()).select(F.sha2(F.col(text), 256).alias("_k"), F.col(text).alias("_t")).dropDuplicates(["_k"])
    items = items.withColumn("_ik", F.sha2("text", 256))
    theirs = _windows(items.select("item_id", "_ik", "text"), "item_id", "_ik")
    sizes = tuple(r.literal for r in theirs.where("literal > 0").select("literal").distinct().collect())  # WINDOW rows at most
    mine = _windows(texts, "_k", literal=sizes)
    pairs = mine.join(theirs, ["h", "literal"]).select("_k", "item_id", "_ik").distinct()
    both = pairs.join(items, ["item_id", "_ik"]).join(texts, "_k").select("_k", "item_id", "text", "_t")

    def run(batches):
        for b in slices(batches):
            keys, hits = [], []
            for k, item, own, t in zip(*(c.to_pylist() for c in b.columns)):
                for hit in Benchmark([(item, own)]).find(t):
                    keys.append(k)
                    hits.append(hit)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([h[i] for h in hits], t) for i, t in enumerate((_IDS[kind], pa.int32(), pa.bool_())))], names=["_k", "item", "n", "changed"])

    hits = both.mapInArrow(run, f"_k string, item {kind}, n int, changed boolean")
    hits = hits.groupBy("_k", "item").agg(F.max_by(F.struct("n", "changed"), F.struct("n", ~F.col("changed"))).alias("b")).select("_k", "item", "b.*")
    found = hits.groupBy("_k").agg(F.array_sort(F.collect_list("item")).alias("items"), F.max("n").alias("most_words"), F.bool_or("changed").alias("reparameterised"))
    out = packed(docs, keep, F.sha2(F.col(text), 256).alias("_k")).join(found, "_k", "left")
    none = F.array().cast(f"array<{kind}>")
    out = out.select(
        "_keep",
        F.col("items").isNotNull().alias("contaminated"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("most_words", F.lit(0)).alias("most_words"),
        F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"),
    )
    return unpacked(out, keep, *_OWN)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *keep: str, text: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Rows (keep, contaminated, n_items, items, most_words, reparameterised), one for each row of ``docs``."""
    keep = tuple(c for c in keep if c not in _OWN)
    kind = "bigint" if isinstance(benchmark.schema["item_id"].dataType, IntegralType) else "string"
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast(kind).alias("item_id"), "text")
    words = items.agg(F.sum(F.regexp_count("text", F.lit(r"\w+")))).first()[0] or 0
    if words > max_broadcast:
        return _joined(docs, items, kind, *keep, text=text)
    got = [(r.item_id, r.text) for r in items.orderBy("item_id", "text").collect()]  # bounded by the check above
    return _scan(docs, got, kind, *keep, text=text)


def op10_decontamination(spark, sf_dir):
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "doc_id")


QUERIES = {"op10_decontamination": op10_decontamination}
ORACLES: dict[str, str] = {}
