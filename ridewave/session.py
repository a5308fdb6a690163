"""Session helpers: the shared checkpoint folder and local test sessions."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ridewave")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RIDEWAVE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def reliable_checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage into the shared checkpoint folder, so a lost executor costs nothing.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only when the
    session names none (tests on one machine) is a scratch folder used.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(
            spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="ridewave-")
        )
    return df.checkpoint(eager)
