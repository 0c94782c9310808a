from __future__ import annotations

import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
PATHS = [os.path.dirname(HERE), HERE]
sys.path[:0] = PATHS
# Python workers import the test modules too.
os.environ["PYTHONPATH"] = os.pathsep.join([*PATHS, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402

from prefdeck.session import configure  # noqa: E402


def build_session() -> SparkSession:
    cores = os.environ.get("BENCH_CPUS", "8")
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("prefdeck-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


@pytest.fixture(scope="session")
def spark():
    return build_session()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
