"""The local session of tests, checks and benchmarks."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("comarca")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no stack traces with columns
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.driver.extraJavaOptions", f"-Djava.io.tmpdir={tempfile.gettempdir()}")
             .config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "warehouse"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
