"""Rows that every operator on texts must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

LONG = "lorem ipsum dolor sit amet consetetur " * 4000
ROWS = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \n\t ", None, "b"),
    (4, LONG, "en", None),
    (5, "one two three", "de", "b"),
    (5, "one two three", "de", "b"),
    (6, "one two three", "de", "c"),
    (None, "one two three", None, None),
    (None, None, None, None),
    (7, "ünïcödé \U0001f600 text \u0000 with\nlines\nand more", "fr", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators use inside; the values must neither matter nor break anything.
CLASHES = ("id", "text_key", "spans", "matches", "removed", "rebuilt", "set_id", "key", "row", "found", "value", "n", "repo", "owner")


def frame(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHES:
        df = df.selectExpr("*", f"'x' as {name}")
    return df


def empty(spark):
    return frame(spark).limit(0)
