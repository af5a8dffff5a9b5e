import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, langs=None, sources=None, extra=None):
        rows = [
            (ids[i] if ids else i, t, langs[i] if langs else ("en", "fr", None)[i % 3], sources[i] if sources else ("a", "b", None)[i % 3], len(t) if t is not None else None)
            for i, t in enumerate(texts)
        ]
        df = spark.createDataFrame(rows, DOCS)
        return df if extra is None else extra(df)

    return make


@pytest.fixture(scope="session")
def clashing():
    """Adds columns that are named as the operators' own."""
    from pyspark.sql import functions as F

    names = ("score", "spans", "fp", "rep", "key", "component_id", "kept", "n_words", "ids", "t1", "t2", "ident", "hits", "n_tokens", "predicted", "_kept", "label", "f_lang", "start", "windows")
    return lambda df: df.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture
def draw():
    return random.Random(5)
