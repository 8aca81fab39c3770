import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from stocktide.session import configure

    builder = SparkSession.builder.master("local[8]").appName("tests")
    session = configure(builder, partitions=4, **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint"))}).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Frame from rows and a DDL schema or a role name."""
    from stocktide.schemas import ROLES

    def build(rows, schema):
        return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ROLES.get(schema, schema))
    return build


@pytest.fixture
def rows():
    """Sorted plain tuples of a frame."""
    def read(df, *cols):
        out = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
        return sorted(out, key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t))
    return read
