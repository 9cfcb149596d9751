from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cases import DDL, ODD, SF  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, DDL)
    # further columns, with names that the operators use inside
    return df.withColumns({n: F.lit(k) for k, n in enumerate(("component", "node", "key", "bin", "size", "label", "score", "kept", "sequence_id", "rep", "first", "block", "n", "a", "b"))})


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
