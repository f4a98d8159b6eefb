import pytest
from pyspark.sql import functions as F

#: (doc_id, text): nulls, empty, blank, one word, ties, repeated rows, a long text
MESSY = [
    (None, "a row without an id but with some words in it, ten or more of them"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "word"),
    (5, "the same text twice in two rows of different ids, long enough to count"),
    (6, "the same text twice in two rows of different ids, long enough to count"),
    (7, "a row that repeats wholly, id and all, with more than ten words in it"),
    (7, "a row that repeats wholly, id and all, with more than ten words in it"),
    (8, "one id, two texts: this is the first one of the two that we have here"),
    (8, "one id, two texts: that is the other one of the two that we have here"),
    (9, " ".join(f"w{i % 9973}é" for i in range(60_000))),
    (10, "x" * 200_000),
]


@pytest.fixture()
def messy(spark):
    docs = spark.createDataFrame(MESSY, "doc_id bigint, text string")
    # names that the operators use themselves
    return docs.select("*", F.lit("h").alias("source"), F.lit(1).alias("text_key"), F.lit(2).alias("uid"), F.lit("c").alias("class"), F.lit(0).alias("kept"), F.lit(None).cast("int").alias("n_words"), F.lit(1).alias("row"), *[F.lit(0).alias(c) for c in ("r_id", "r_key", "r_kept", "r_lines", "g_id", "g_key", "g_root", "body", "level", "word", "n", "part")])


@pytest.fixture()
def nothing(messy):
    return messy.limit(0)


def as_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
