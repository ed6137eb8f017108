"""Sends this package to the executors, so that jobs run from any working directory."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; files of Python only."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    with tempfile.TemporaryDirectory() as stage:
        shutil.copytree(ROOT / "blockloom", Path(stage, "blockloom"), ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
        kept = tempfile.mkdtemp(prefix="blockloom-")  # the driver serves the archive from here for as long as it lives
        atexit.register(shutil.rmtree, kept, ignore_errors=True)
        archive = shutil.make_archive(str(Path(kept, "blockloom_package")), "zip", stage)
    context.addPyFile(archive)
    _sent.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    run.__name__ = getattr(query, "__name__", "query")
    return run
