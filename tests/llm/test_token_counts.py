import random

import public_tokenizers
import pytest

from siltstone.llm.token_counts import Counter, count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aAbé İΣς'stre12³½ \t\n\x1c\x1f\x85\xa0 ̸́<|>startoftext中한‍🙂.,!ßDžﬁ\x00"


@pytest.fixture(scope="module")
def counter():
    return Counter(PATH)


def library(counter, text):
    return len(counter.tokenizer.encode(text, add_special_tokens=False).ids)


def test_equals_library_on_odd_texts(counter):
    draw = random.Random(3)
    for k in range(6000):
        text = "".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 16)))
        if k % 3 == 0:
            text += draw.choice(["<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|>"]) + draw.choice(ALPHABET)
        assert counter.count(text) == library(counter, text), repr(text)


def test_table_is_bounded():
    small = Counter(PATH, table_size=10)
    text = " ".join(f"word{i}x" for i in range(500))
    assert small.count(text) == library(small, text)


def test_rows(spark, counter):
    texts = [None, "", "The <|endoftext|> end", "ab " * 60000, "same", "same"]
    docs = spark.createDataFrame([(i if i else None, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = sorted(count_tokens(docs.drop("n_tokens"), PATH, "doc_id").collect(), key=lambda r: r.doc_id or 0)
    assert [r.n_tokens for r in got] == [0 if not t else library(counter, t) for t in texts]
    assert [r.n_bytes for r in got] == [len(t.encode()) if t else 0 for t in texts]
    assert [r.over_limit for r in got] == [False, False, False, True, False, False]
    assert count_tokens(docs.where("false"), PATH, "doc_id").count() == 0


def test_all_documents_equal_library(spark, counter):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: library(counter, r.text) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, PATH, "doc_id").collect()} == want
