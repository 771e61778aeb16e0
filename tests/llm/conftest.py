import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def make(spark):
    """Documents from ``(doc_id, text)`` pairs, with the columns of the table."""

    def build(rows, extra=False):
        schema = T.StructType(
            [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
             T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
        )
        df = spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], schema)
        for name in ("ids", "tokens", "score", "kept", "start", "hash", "component_id", "keep_id") if extra else ():
            df = df.withColumn(name, df["text"])
        return df

    return build
