import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from lumensift.session import ship_package

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("_text", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """(doc_id, text, lang) tuples as documents with extra columns whose names the operators use themselves."""
    ship_package(spark)

    def make(rows):
        return spark.createDataFrame([(i, t, lang[0] if lang else None, "x", "y") for i, t, *lang in rows], DOCS)
    return make


AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "alpha"), (4, "alpha"), (5, "!!! ??? 123"), (None, "some words without an id"), (6, "zero\x00byte and ÀÉ ünïcode 中文 words"), (7, "long " * 30_000),
    (8, "alpha"), (9, ""),
]
