"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, a local master gets one of its own, others an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="veilgrid-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A folder name of its own under the shared one."""
    return f"{shared_dir(spark)}/veilgrid/{name}-{uuid.uuid4().hex}"
