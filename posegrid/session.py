"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", app: str = "posegrid", **conf: str) -> SparkSession:
    """Local session with adaptive execution on; a cluster brings its own."""
    shuffle = str(cores) if isinstance(cores, int) else str(os.cpu_count() or 8)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("POSEGRID_DRIVER_MEMORY", "6g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
