import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    return local_session(4, partitions=4)


@pytest.fixture
def rows(spark):
    """rows(schema, [tuples]) → DataFrame with ISO strings cast to dates where the schema says so."""

    def make(schema: str, data: list[tuple]):
        fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
        text = ", ".join(f"{n} {'string' if k == 'date' else k}" for n, k in fields)
        frame = spark.createDataFrame(data, text)
        for name, kind in fields:
            if kind == "date":
                frame = frame.withColumn(name, frame[name].cast("date"))
        return frame

    return make
