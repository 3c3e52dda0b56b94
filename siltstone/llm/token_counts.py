"""Token counts with a whole-token shortcut.

``whole_tokens`` proves which vocabulary strings encode alone as exactly one token: it decodes each entry that ends a word and encodes
it again with the library. A text is cut at ASCII white space into chunks, each chunk is normalised and cut into pre-tokens by the
tokenizer's own rules; a pre-token in the proven set counts one, only the others go through the merges. Counts are remembered by
chunk in a table of bounded size. A chunk that may hold a special token is encoded by the library itself.

White space cannot be inside a pre-token, no normalisation step looks across it, and special tokens hold none; so the sum over chunks is
the count of the whole text. Narrow: no shuffle, each Arrow batch is counted where it is read.

Defined cases: a null or empty text has 0 bytes and 0 tokens; very long texts are counted whole; repeated rows repeat in the result; there are no ties; an
empty table gives no rows; a kept column with the name of one of the operator's own gives way to it.
"""

from __future__ import annotations

import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import documents, unused

LIMIT = 2048
#: Entries kept in a worker's table of chunks before it starts anew.
TABLE_SIZE = 1_000_000


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class Counter:
    """Counts tokens as the library's ``encode(text, add_special_tokens=False)`` does."""

    def __init__(self, path: str, table_size: int = TABLE_SIZE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.load(open(path))
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.end = spec["model"]["end_of_word_suffix"]
        self.letters = _byte_letters()
        self.whole = self.whole_tokens(spec["model"]["vocab"])
        self.table: dict[str, int] = {}
        self.table_size = table_size

    def whole_tokens(self, vocab: dict[str, int]) -> frozenset[str]:
        """Pre-tokens proven to be one token: those that the library encodes to their own id alone."""
        bytes_of = {chr(v): k for k, v in self.letters.items()}
        words = []
        for entry, number in vocab.items():
            if entry.endswith(self.end) and len(entry) > len(self.end):
                try:
                    words.append((bytes(bytes_of[c] for c in entry[: -len(self.end)]).decode(), number))
                except (KeyError, UnicodeDecodeError):
                    continue
        got = self.tokenizer.encode_batch([w for w, _ in words], add_special_tokens=False)
        return frozenset(w for (w, number), e in zip(words, got) if e.ids == [number] and self.pattern.fullmatch(w))

    def pre_token(self, pre_token: str) -> int:
        if pre_token in self.whole:
            return 1
        n = self.table.get(pre_token)
        if n is None:
            n = self.table[pre_token] = len(self.tokenizer.model.tokenize(pre_token.encode().decode("latin-1").translate(self.letters)))
        return n

    def chunk(self, chunk: str) -> int:
        for special in self.specials:
            if special in chunk:
                return len(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        # Below U+0250 nothing composes and no letter's lower case depends on its neighbours.
        normal = chunk.lower() if chunk.isascii() or max(chunk) < "\u0250" else self.tokenizer.normalizer.normalize_str(chunk)
        if normal.isascii():
            if normal.isalpha():
                return self.pre_token(normal)
            if normal[:-1].isalpha() and normal[-1] in ".,;:!?":
                return self.pre_token(normal[:-1]) + self.pre_token(normal[-1])
        return sum(map(self.pre_token, self.pattern.findall(normal)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        table, total = self.table, 0
        for chunk in text.encode().split():
            n = table.get(chunk)
            if n is None:
                if len(table) >= self.table_size:
                    table.clear()
                n = table[chunk] = self.chunk(chunk.decode())
            total += n
        return total


def count_tokens(docs: DataFrame, tokenizer_path: str, *keep: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Rows (keep, n_bytes, n_tokens, over_limit), one for each row of ``docs``."""
    keep = [c for c in keep if c not in ("n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(*keep, F.col(text).alias(unused(keep, "_text")))
    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields[:-1]), "n_bytes long", "n_tokens long", "over_limit boolean"])

    def run(batches):
        counter = Counter(tokenizer_path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            tokens = [counter.count(t) for t in texts]
            sizes = [len(t.encode()) if t else 0 for t in texts]
            own = [pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], names=[*batch.schema.names[:-1], "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, schema)


def op1_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), "doc_id")


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLES: dict[str, str] = {}
