from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pytest
from pyspark.sql import SparkSession

from plumbline.session import ship


@pytest.fixture(scope="session")
def spark() -> Iterator[SparkSession]:
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.host", "127.0.0.1").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
