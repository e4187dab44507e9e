import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from plumbline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(min(8, os.cpu_count() or 4), "plumbline-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def load(spark, tmp_path):
    """CSV text as a typed table with a row number to order by."""
    from pyspark.sql import functions as F

    from plumbline.sources.csv import read_csv

    def read(text: str):
        path = tmp_path / f"{abs(hash(text))}.csv"
        path.write_text(text, encoding="utf-8")
        df = read_csv(spark, str(path))
        return df.withColumn("__row", F.monotonically_increasing_id())

    return read


@pytest.fixture
def check(load):
    """CSV text as an assessment of all columns but the row number."""
    from plumbline import Assessment

    def assess(text: str, **options):
        df = load(text)
        columns = [c for c in df.columns if c != "__row"]
        return Assessment(df, "test", columns=columns, order_by=["__row"], **options)

    return assess
