import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])

LONG = " ".join(f"word{i % 977} of a very long text," for i in range(6000))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls anywhere, empty and very long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, "Plain words of one text stand here, one after the other.", "en", "a", 10),
        (1, "Plain words of one text stand here, one after the other.", "en", "a", 10),
        (2, "plain WORDS of one text stand here, one after the other.", "en", "a", 10),
        (3, "", "en", "b", 0), (4, None, None, None, None), (5, "   \n\t ", "fr", "b", None),
        (None, "A text without an id.", "en", "a", 3), (None, None, None, None, None),
        (6, LONG, "en", None, len(LONG)), (7, LONG + " end", "en", "c", len(LONG) + 4),
        (8, "123 456 !!! ???", None, "c", 15), (9, "日本語のテキスト é ß   x", "ja", "d", 9),
        (10, "you stupid idiot", "en", "d", 16), (11, "x", "en", "a", 1)]
    from pyspark.sql import functions as F

    plain = spark.createDataFrame(rows, DOCUMENTS)
    return (plain.withColumn("score", F.lit(7.0)).withColumn("features", F.lit("mine"))
            .withColumn("fp", F.lit(1)).withColumn("component", F.lit(2)).withColumn("tokens", F.lit(3))
            .withColumn("_raw", F.lit("r")).withColumn("rank", F.lit(0)).withColumn("key", F.lit("k")))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
