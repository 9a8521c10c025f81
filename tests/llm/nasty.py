"""A table of documents with everything that may come: nulls, empty and very long texts, copies, clashing columns."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
ROWS = [
    (1, "Hello World, it's me: Thing-1 thing-2!\nLine two of it.\n\nLine two of it.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, " \t\n\x0b\x0c\r", "de", None),
    (5, LONG, "en", "b"),
    (6, LONG.replace(" ", "\n", 3), "en", "b"),
    (7, "same row", "fr", "c"),
    (7, "same row", "fr", "c"),
    (8, "same  row", "fr", "a"),
    (None, "same row", None, None),
    (9, "Ünï çødé Σίσυφος 漢字 <|endoftext|> \u00a0x\u2028y 🙂🙂 İI e\u0301", "es", "c"),
    (10, "x" * 70_000, "es", "c"),
    (11, "one", "en", "a"),
    (12, "ONE", "en", "a"),
]
# Names the operators use inside.
CLASHING = ["row", "n", "name", "fp", "chunk", "score", "part", "block", "sha", "_row", "size", "copies", "taken", "node", "root", "held_out"]


def documents(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(2)
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHING})


def empty(spark):
    return documents(spark, [])
