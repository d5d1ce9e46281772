import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        # Names the operators use themselves; they must not mind.
        T.StructField("node", T.StringType()),
        T.StructField("component", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        whole = [(i, t, lang, "x", 7) for i, t, lang in ((*r, None)[:3] for r in rows)]
        return spark.createDataFrame(whole, DOCS)

    return make
