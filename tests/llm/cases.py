"""A small table of awkward documents."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("length", T.StringType()), T.StructField("kept", T.StringType())])
LONG = " ".join(f"word{i % 977}" for i in range(6000))


def documents(spark):
    rows = [
        (0, "Alpha beta gamma delta epsilon zeta.\nsecond line here\nsecond line here", "en", "a", 10),
        (1, None, "en", "a", 0),
        (2, "", None, "b", 0),
        (3, " \t\n", "fr", None, 3),
        (4, "Alpha beta gamma delta epsilon zeta.\nsecond line here\nsecond line here", "en", "a", 10),
        (5, "alpha  beta gamma delta epsilon zeta.\nSecond line here\nsecond line here ", "en", "a", 10),
        (6, LONG, "de", "b", 1),
        (7, LONG + " tail", "de", "b", 1),
        (8, "12345 67890 !!!", "en", "c", 1),
        (9, "one two three", None, None, None),
        (9, "one two three", None, None, None),
        (None, "no id at all here", "en", "c", 2),
        (10, "été où ça 中文 😀 x", "fr", "c", 2),
        (11, "one two three", "en", "c", 2),
        (12, "a" * 5000, "en", "d", 2),
    ]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
