import pytest
from pyspark.sql import functions as F


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text, lang) as a documents table with a column whose name may clash."""
    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        return df.select("*", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"),
                         F.lit(1).alias("score"), F.lit("x").alias("key"), F.lit(2).alias("component_id"))
    return make
