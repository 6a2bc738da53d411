"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        """(doc_id, text[, lang[, source]]) -> documents"""
        full = [
            (r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or ""))
            for r in rows
        ]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Odd rows, and columns whose names are those that operators use or return."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{i % 977} thing{i % 31}," for i in range(20_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three four"),
        (5, "one two three four"), (None, "one two three four"), (None, None),
        (6, long), (7, "12 34 !!", None, None), (8, "é😀 日本語 ñandú\n\n", "es", None),
    ]
    clashing = (
        "id", "node", "n", "bands", "score", "held_out", "size", "copies", "kept", "component_id",
        "made", "found", "label", "ids", "spans", "n_words", "__copy", "chunk",
    )
    return docs_of(rows).withColumns({name: F.lit("x") for name in clashing})
