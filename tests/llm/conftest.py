import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def docs(spark):
    import helpers

    return spark.createDataFrame(helpers.corpus(), helpers.SCHEMA).repartition(4, "doc_id").cache()


@pytest.fixture(scope="session")
def clash(docs):
    """The same rows with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    out = docs
    for name in ("h", "s", "e", "a", "c", "hs", "spans", "content", "n_tokens", "ids", "sig", "d1", "d2", "n", "crc", "score", "lang_pred", "held_out", "grade", "class_id", "_ranges", "_removed_ranges", "key", "worded", "block", "part", "hash", "size"):
        out = out.withColumn(name, F.lit("x"))
    return out


@pytest.fixture(scope="session")
def none(spark):
    import helpers

    return spark.createDataFrame([], helpers.SCHEMA)


def pytest_configure():
    pytest.importorskip("public_tokenizers")
