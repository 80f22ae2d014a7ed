"""Small tables with the awkward rows every operator has to bear."""

from __future__ import annotations

EXTRA = ["key", "size", "n", "class", "token", "row", "place", "copies", "score", "line", "words", "part", "rank"]

ROWS = [
    (1, "a b c d e", "en", "s1"),
    (2, "A b  c d e", "en", "s1"),
    (3, None, None, None),
    (4, "", "en", "s2"),
    (5, "a b", "de", "s2"),
    (6, "a b", "de", "s2"),
    (6, "a b", "de", "s2"),
    (None, "x y z", "en", None),
    (7, " \n\t \n", "fr", "s3"),
    (8, "12 34 !!", "fr", "s3"),
    (9, "w " * 30_000, "fr", "s1"),
]


def documents(spark, rows=ROWS, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df = df.selectExpr("*", "cast(length(text) as bigint) as n_chars")
    for name in EXTRA if extra else []:
        df = df.selectExpr("*", f"'{name}' as {name}")
    return df


def empty(spark):
    return documents(spark).limit(0)
