from __future__ import annotations

import pytest
from pyspark.sql import functions as F

LONG = ("Der lange Text hat viele Wörter und eine Zeile nach der anderen. " * 40 + "\n") * 60
PASSAGE = " ".join(f"passage{k}word" for k in range(70))


@pytest.fixture(scope="session")
def ugly(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns whose names clash."""
    rows = [
        (1, "Hello there world, this is a plain English text about the weather and the sea.", "en", "a"),
        (2, None, "en", "a"),
        (None, "A text whose id is missing, with the words that others have.", None, None),
        (3, "", "de", "b"),
        (4, " \t\n ", None, "b"),
        (5, LONG, "de", "c"),
        (6, LONG, "de", "c"),
        (7, "Ünïcödé ▁ 日本語 😀  \r\n end", "xx", "ß"),
        (8, "x" * 5000, None, "c"),
        (9, "one", "en", None),
        (9, "one", "en", None),
        (10, f"start of ten {PASSAGE} and the end", "en", "a"),
        (11, f"quite another beginning here {PASSAGE} finish", "en", "a"),
        (12, "MIT License and MIT license, cc by the way", "en", "a"),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    extra = {c: F.lit(1) for c in ("i", "t", "th", "node", "spans", "copies", "size", "r", "key", "n", "shard_", "start", "pieces_", "fp", "bucket", "rank", "_text", "_key", "pi", "last", "block", "u", "v", "range", "ghost")}
    return df.withColumns(extra)


@pytest.fixture(scope="session")
def empty(ugly):
    return ugly.limit(0)
