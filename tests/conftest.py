import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def hospital(spark, tmp_path_factory):
    """The seven hospital tables, read from CSV."""
    from cohortloom.sources import drop_header_rows, read_entity
    from tests.hospital import write

    paths = write(tmp_path_factory.mktemp("hospital"))
    tables = {entity: read_entity(spark, entity, path) for entity, path in paths.items()}
    tables["patients"] = drop_header_rows(tables["patients"], "SUBJECT_ID")
    tables["paths"] = paths
    return tables


@pytest.fixture(scope="session")
def rows():
    def collect(df):
        """Rows as sorted tuples."""
        return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is not None, str(v)) for v in t))

    return collect
