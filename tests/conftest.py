from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from versespan.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(app="tests", cpus=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def evaluate(spark):
    """Values of a column function over a list of inputs, in order."""
    def run(values, function, kind="string"):
        from pyspark.sql import functions as F
        df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
        rows = df.select("i", function(F.col("x")).alias("y")).collect()
        return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]

    return run


@pytest.fixture
def frame(spark):
    def make(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return make


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)
