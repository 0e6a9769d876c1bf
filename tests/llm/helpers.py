"""Rows that hold what every operator must survive: nulls in every column, empty and very long texts, repeats, columns with names of its own."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep boolean, sig binary, token long, bin_id string, length string, spans string, ids string, group_id long, size int"


def docs(spark, texts, extra=True):
    """(doc_id, text) pairs as a table; with columns whose names the operators use themselves."""
    if not extra:
        return spark.createDataFrame(list(texts), "doc_id long, text string")
    rest = (None, None, None, True, b"x", 7, "b", "l", "s", "i", 9, 3)
    return spark.createDataFrame([(d, t, *rest) for d, t in texts], DOCS)


LONG = "Many words of ordinary prose follow each other here and there. " * 20_000
ODD = [(1, None), (2, ""), (3, "   \n "), (4, LONG), (4, LONG), (5, "Short text."), (5, "Short text."), (None, "A text without number."), (None, None), (6, "日本語のテキスト 🙂 é́"), (7, "\x00\x01 control")]
