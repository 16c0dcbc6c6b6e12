"""Python workers must find this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def reach(spark: SparkSession) -> None:
    """Workers on this machine get the package's folder; clusters get the package by --py-files."""
    here = str(Path(__file__).resolve().parents[1])
    paths = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if here not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{here}:{paths}".rstrip(":")
