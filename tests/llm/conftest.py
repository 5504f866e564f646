import pathlib
import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source) rows, with columns whose names operators might use."""

    def run(rows, clash=True):
        rows = [tuple(r) + (None,) * (4 - len(r)) for r in rows]
        df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], SCHEMA)
        if clash:
            for c in ("score", "size", "_h", "_p", "k", "t", "c", "v", "_made", "_size", "_copies", "shard", "slot", "found", "Digest", "p", "rest", "before", "full", "cut", "targets", "taken", "more", "a.b", "we`ird"):
                df = df.withColumn(c, F.lit("x"))
        return df

    return run


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def rnd():
    return random.Random(7)


@pytest.fixture(scope="session")
def sf():
    assert pathlib.Path(SF).exists()
    return SF
