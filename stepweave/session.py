"""Sessions for local runs; on a cluster, pass your own session to every operator."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str = "stepweave", *, cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, in UTC, with adaptive execution.

    Sizes of partitions are Spark's own matter at run time: adaptive execution joins small shuffle
    partitions and splits skewed ones, so ``shuffle_partitions`` only bounds them from above.
    """
    conf = {
        "spark.master": f"local[{cpus}]",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.host": "127.0.0.1",
    }
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()
