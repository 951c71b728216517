import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, an empty, a very long and repeated texts, repeated ids and clashing columns."""
    words = [f"w{i % 977}" for i in range(60_000)]
    rows = [
        (1, "Hello, World! 'tis the <|endoftext|> end", "en", "a", 5), (2, None, "en", "a", None), (3, "", None, None, 0), (4, " ".join(words), "en", "b", None), (5, "same text here now ok", "en", "b", 1),
        (5, "same text here now ok", "en", "b", 1), (6, "same text here now ok", "fr", None, 1), (None, "no id at all", None, "c", 1), (7, "Déjà vu 😀 naïve façade, ça va?", "fr", "c", 3), (8, " \n\t ", "de", "c", 3),
        (9, "...!!! 123", "de", "c", 3),
    ]
    return spark.createDataFrame(rows, DOCUMENTS).withColumn("size", F.lit(-1)).withColumn("copies", F.lit("x")).withColumn("_key", F.lit(0)).withColumn("score", F.lit(0.5)).withColumn("a.b", F.lit(1)).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
