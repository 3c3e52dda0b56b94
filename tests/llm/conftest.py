import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and values, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"word{i % 977} of{i % 13}" for i in range(30000))
    prose = "The quick brown fox jumps over the lazy dog while seven wizards make toxic jugs of juice for the old king of the north " * 3
    rows = [
        (1, None, "en", "a", 0, "x"), (2, "", "en", "a", 0, "x"), (3, " \n\t ", None, None, None, None), (None, prose, "en", None, 1, "y"), (5, prose, "en", "b", 2, "z"),
        (5, prose, "en", "b", 2, "z"), (6, long, "de", "b", 3, "w"), (7, "Licensed under the Apache License, Version 2.0.", None, "c", 4, "v"), (8, "éß ЖЖ 中文 \x00 |||", "fr", "c", 5, "u"), (None, None, None, None, None, None),
    ]
    rows += [(100 + i, f"short text {i % 3}", "en", "a", i, "t") for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, kept string").coalesce(3).cache()
