import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with inner ones."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("id", T.StringType()), T.StructField("n", T.StringType()), T.StructField("h", T.StringType())])

    def make(rows):
        return spark.createDataFrame([(i, t, (r or [None])[0], "x", "y", None) for i, t, *r in rows], schema)

    return make
