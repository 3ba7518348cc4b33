"""Hard inputs shared by the operator tests, with clashing extra columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("word", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("t_", T.StringType()), T.StructField("hash", T.LongType()),
])

TEXTS = [
    None, "", " ", "\n", "\n\n \t\n", "a", "one two", "one two three one two three one two three",
    "x y z\nx y z\n\nX Y Z\n  x y z  ", "tab\tvt\x0bff\x0ccr\rnbsp nel\u0085ls end", "é" * 50 + " ñandú\U0001f600 ok\U0001f600",
    "# * $ % & | < > !", "word " * 3000, "a" * 20000, "0" * 5000, "1 " * 3000, "a@b.c d@e.f", "null\x00byte \x1c\x1d\x1e\x1f sep",
    "the same line of text that is rather long, repeated in places\nother\nthe same line of text that is rather long, repeated in places",
] + ["A document that repeats exactly, with enough words to be more than a few shingles of text."] * 3


def frame(spark, texts=None, langs=None):
    texts = TEXTS if texts is None else texts
    rows = [(i, t, (langs[i] if langs else ["en", "fr", None][i % 3]), None, 1, "w", i, "clash", 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)
