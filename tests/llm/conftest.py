import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    def make(*rows):
        return spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def prose():
    """Texts of distinct words: word n of text t is `w<t>x<n>`."""
    return lambda t, n, begin=0: " ".join(f"w{t}x{i}" for i in range(begin, begin + n))
