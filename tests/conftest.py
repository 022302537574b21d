import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from recordloom.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "recordloom-tests", spark__ui__showConsoleProgress="false")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def records(spark):
    """Records of one dataset from dicts of texts; the position is the index."""

    def build(rows, dataset="d", source_file="d.json"):
        return spark.createDataFrame(
            [(dataset, source_file, i, row) for i, row in enumerate(rows)],
            "dataset string, source_file string, record_index bigint, raw map<string,string>",
        )

    return build


@pytest.fixture
def pairs(spark):
    """(key_name, value) rows under one key."""

    def build(values, key="k"):
        return spark.createDataFrame([(key, v) for v in values], "key_name string, value string")

    return build
