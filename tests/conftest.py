"""One small local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"ui.enabled": "false", "ui.showConsoleProgress": "false", "sql.shuffle.partitions": "4", "sql.session.timeZone": "UTC", "driver.memory": "4g", "checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    builder = SparkSession.builder.master("local[4]").appName("tests")
    for key, value in conf.items():
        builder = builder.config(f"spark.{key}", value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
