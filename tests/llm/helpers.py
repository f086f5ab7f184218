"""Rows that every text operator must take."""

from pyspark.sql import functions as F

LONG = "word " * 30_000 + "x" * 40_000 + " end. " + "A line, and another one!\n" * 400

ODD = [(1, "One text. And more of it!"), (1, "One text. And more of it!"), (2, None), (3, ""), (None, "no id here"), (None, None), (4, LONG), (5, " \n\t "), (6, "é ﬁ 日本 𝄞 <|endoftext|> ▁ \x00 \x85"), (7, "One text. And more of it!"), (1, "another text with the same id")]
CLASHES = ("id", "ids", "fp", "node", "label", "n", "vector", "cut", "r1", "r2", "h1", "bucket", "guard", "spans", "length", "salt", "rank", "good", "kept", "score", "pos", "line", "site", "first", "root", "key", "t")


def odd_rows(spark, clashes=True):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("source", F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("s"), "doc_id")))
    return df.withColumns({c: F.lit("clash") for c in CLASHES}) if clashes else df


def no_rows(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shingle_set(text, width):
    words = text.lower().split()
    if len(words) < width:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))
