"""Session factory and table loading."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "stowage", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster, pass your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it; on a cluster, pass it with --py-files instead."""
    own, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if own not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), own]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
