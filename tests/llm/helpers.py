"""Awkward tables: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["_text", "shard", "slot", "size", "_h", "_id", "keys", "items", "score", "ids", "fp", "node", "part", "nth", "a", "b", "kept", "base", "more", "label", "id", "windows", "start", "rank"]

EN = "the quick brown fox jumps over the lazy dog while seven wizards brew a very strange potion in the old tower"
DE = "der schnelle braune fuchs springt über den faulen hund und sieben zauberer brauen im alten turm einen trank"


def texts():
    line = "A shared line of some length\n"
    return [
        (1, f"{EN}\n{line}unique one", "en"), (2, f"{EN}\n{line}unique one", "en"), (3, None, None), (4, "", "en"),
        (5, f"{EN} {EN} mail bob@example.org now\n  a SHARED line of some length\t\n\nend", "en"), (6, " \n\t ", "de"),
        (7, DE, "de"), (8, DE + " 4111 1111 1111 1111 +1 (366) 555-9807", "de"), (9, "12345 !!! ###", None), (10, "é" * 10 + "\n" + "é" * 9, "fr"),
        (11, (EN + ".\n") * 400, "en"), (12, "é" * 10 + "\n" + "é" * 9, "fr"), (None, "no id here but text", None), (12, "é" * 10 + "\n" + "é" * 9, "fr"), (13, "x", "en"),
    ]


def awkward(spark, repeated: bool = True):
    rows = [(i, t, lang, None, len(t) if t else None) for i, t, lang in texts()]
    if not repeated:
        rows = list({r[0]: r for r in rows if r[0] is not None}.values())
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
