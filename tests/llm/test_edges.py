"""Every operator and stage on odd rows and on empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import decontamination, licenses, lm_scoring, mixing, near_duplicates, quality_classifier, quality_rules, repeated_passages, sharding, token_counts
from siltstone.llm.common import Scratch


def _labels(spark):
    return spark.createDataFrame([(5, 1, 0), (6, 0, 0), (6, 1, 1), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")


def _bench(spark):
    return spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog while seven wizards make"), (2, None), (None, "x"), (3, ""), (4, "of")], "item_id long, text string")


OPS = {
    "op1": lambda s, d: token_counts.count_tokens(d, public_tokenizers.path("word_bpe_49k.json"), "doc_id"),
    "op2": lambda s, d: lm_scoring.score(d, Scratch(s, "t"), "doc_id"),
    "op3": lambda s, d: sharding.shard(d, Scratch(s, "t"), "doc_id", shards=4),
    "op4": lambda s, d: licenses.scan_licenses(d, "doc_id"),
    "op5": lambda s, d: quality_rules.apply_rules(d, Scratch(s, "t"), "doc_id"),
    "op6": lambda s, d: repeated_passages.remove_repeats(d, Scratch(s, "t"), "doc_id"),
    "op7": lambda s, d: mixing.mix(d, Scratch(s, "t"), "doc_id"),
    "op8": lambda s, d: quality_classifier.classify(d, _labels(s), Scratch(s, "t"), "doc_id"),
    "op9": lambda s, d: near_duplicates.near_duplicates(d, Scratch(s, "t"), "doc_id"),
    "op10": lambda s, d: decontamination.decontaminate(d, _bench(s), "doc_id"),
}


@pytest.mark.parametrize("name", OPS)
def test_one_row_for_each_row(spark, odd, name):
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in OPS[name](spark, odd).select("doc_id").collect())
    assert got == sorted((r.doc_id is None, r.doc_id or 0) for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, odd, name):
    assert OPS[name](spark, odd.where("false")).collect() == []


CLASH = {"op1": "n_tokens", "op3": "size", "op4": "labels", "op5": "n_words", "op6": "n_removed", "op7": "target", "op8": "p_toxic", "op9": "class_id", "op10": "items"}
INNER = {"op1": "_text", "op3": "at", "op4": "_text", "op5": "m_symbols", "op6": "_k", "op7": "_h", "op8": "_host", "op9": "keys", "op10": "_k"}


@pytest.mark.parametrize("name", CLASH)
def test_clashing_names(spark, odd, name):
    """Kept columns with the names of own columns give way, those with names used inside stay as they are."""
    docs = odd.withColumn(CLASH[name], F.lit("theirs")).withColumn(INNER[name], F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string"))
    keep = ["doc_id", CLASH[name], INNER[name]]
    run = {
        "op1": lambda: token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), *keep),
        "op3": lambda: sharding.shard(docs, Scratch(spark, "t"), *keep, shards=4),
        "op4": lambda: licenses.scan_licenses(docs, *keep),
        "op5": lambda: quality_rules.apply_rules(docs, Scratch(spark, "t"), *keep),
        "op6": lambda: repeated_passages.remove_repeats(docs, Scratch(spark, "t"), *keep),
        "op7": lambda: mixing.mix(docs, Scratch(spark, "t"), *keep),
        "op8": lambda: quality_classifier.classify(docs, _labels(spark), Scratch(spark, "t"), *keep),
        "op9": lambda: near_duplicates.near_duplicates(docs, Scratch(spark, "t"), *keep),
        "op10": lambda: decontamination.decontaminate(docs, _bench(spark), *keep),
    }[name]
    got = run()
    assert len(got.columns) == len(set(got.columns))
    rows = got.collect()
    assert len(rows) == odd.count() and all(r[CLASH[name]] != "theirs" for r in rows)
    if INNER[name] not in ("m_symbols",):
        assert all(r[INNER[name]] == str(-1 if r.doc_id is None else r.doc_id) for r in rows)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_ids_of_any_type(spark, odd, kind):
    docs = odd.withColumn("doc_id", F.col("doc_id").cast(kind))
    labels = _labels(spark).withColumn("doc_id", F.col("doc_id").cast("string"))
    assert quality_classifier.classify(docs, labels, Scratch(spark, "t"), "doc_id").count() == odd.count()
    bench = _bench(spark).withColumn("item_id", F.concat(F.lit("item-"), "item_id"))
    got = decontamination.decontaminate(docs, bench, "doc_id").where("contaminated").collect()
    assert got and all(r["items"] == ["item-1"] for r in got)
    for name in ("op3", "op7", "op9"):
        assert OPS[name](spark, docs).count() == odd.count()


def test_values_on_odd_rows(spark, odd):
    """What the docstrings define for nulls, empty texts, repeated rows and ties."""
    rows = {name: {} for name in ("op3", "op4", "op6", "op7", "op8", "op9", "op10")}
    for name, by in rows.items():
        for r in OPS[name](spark, odd).where("doc_id IS NOT NULL").collect():
            by.setdefault(r.doc_id, []).append(r)
    assert rows["op3"][1][0]["size"] == 8 and rows["op3"][1][0].text_crc32 == 0 and rows["op3"][2][0]["size"] == 8 and len({r.slot for r in rows["op3"][5]} | {r.shard for r in rows["op3"][5]}) >= 2
    assert (rows["op4"][1][0].n_words, rows["op4"][1][0].labels, rows["op4"][1][0].score) == (0, "", 0.0) and rows["op4"][7][0].labels == "apache,apache-2.0"
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in rows["op6"][1] + rows["op6"][2]] == [(0, 0, 0)] * 2
    assert all(r.n_removed == r.n_bytes and bytes(r.kept) == b"" for r in rows["op6"][5])  # equal rows are repeats of each other
    assert rows["op7"][1][0].copies * rows["op7"][1][0]["size"] == 0 and all(0 <= r.copies <= 3 for by in rows["op7"].values() for r in by)
    assert all(0 <= r.p_quality <= 1 for by in rows["op8"].values() for r in by) and rows["op8"][5][0].p_quality == rows["op8"][5][1].p_quality
    assert [(r.n_copies, r.n_links) for r in rows["op9"][5]] == [(3, 2)] * 2 and rows["op9"][5][0].class_id == 5 and rows["op9"][100][0].n_copies == 4
    assert (rows["op9"][1][0].n_copies, rows["op9"][2][0].n_copies) == (1, 1)  # null and empty texts are not equal
    assert [rows["op10"][k][0].contaminated for k in (1, 2, 3, 5)] == [False, False, False, True]


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, odd, stage, tmp_path):
    _labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    _bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    name, run = corpus_pipeline.STAGES[stage]
    for docs in (odd, odd.where("false")):
        got = run(spark, docs, str(tmp_path))
        if stage < 4:
            assert got.columns == docs.columns
        got.collect()
    if name == "near_duplicates":
        assert run(spark, odd, str(tmp_path)).where("doc_id = 5 OR (doc_id IS NULL AND text IS NOT NULL)").count() == 1
    if name == "decontamination":
        assert run(spark, odd, str(tmp_path)).where(F.col("text").contains("quick brown fox")).count() == 0


def test_quality_rules_values(spark, odd):
    got = {r.doc_id: r for r in OPS["op5"](spark, odd).where("doc_id IS NOT NULL").collect()}
    assert (got[1].n_words, got[3].n_words, got[5].n_words) == (0, 0, 72)
    assert got[5].n_repeat_words == 72 and got[5].base_failed and not got[5].kept
    assert got[8].n_symbols == 3 and got[8].word_chars == 10


def test_null_rows_of_scores(spark, odd):
    for r in OPS["op2"](spark, odd).where("doc_id <= 3").collect():
        assert (r.n_tokens, r.n_known) == (1, 1)
