"""Awkward documents for the operators' tests."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, n long"


def odd_docs(spark, texts=None):
    """Null and empty texts, white space alone, a long text, ties, repeated rows, null ids, clashing extra columns."""
    long = " ".join(f"w{i % 977}" for i in range(20000))
    texts = texts or [
        (1, "one two three four five six seven"), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, long + " tail"),
        (7, "one two three four five six seven"), (8, "é ü ñ — “quoted” 日本語　text"), (None, "no id here at all"), (None, None),
        (9, "a\nb\nc"), (9, "a\nb\nc"), (9, "same id, other text"), (10, "<|endoftext|> and 'll it's"),
    ]
    return spark.createDataFrame([(i, t, None, "src0", None, 1, 2, 3) for i, t in texts], SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
