"""Sessions and the folder for checkpoints."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster bring your own."""
    base = {
        "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.driver.memory": "8g",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoints(spark: SparkSession) -> None:
    """Sets a checkpoint folder only where neither the session nor the cluster names one."""
    inner = spark.sparkContext._jsc.sc()
    if inner.getCheckpointDir().isEmpty():
        known = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not known and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(known or tempfile.mkdtemp(prefix="tessera-"))
