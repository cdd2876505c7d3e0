"""Python workers: the package's place on their path."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def send_package(spark: SparkSession) -> None:
    """Lets local Python workers import this package, wherever the driver found it; on a cluster it goes with --py-files."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])
