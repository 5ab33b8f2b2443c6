"""Session defaults. On a cluster the submitter's settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str, cores: int | None = None, **conf: str) -> SparkSession:
    """A local session with the defaults that the operators expect."""
    cores = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    b = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", str(max(4, cores)))
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
