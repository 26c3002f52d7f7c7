"""A fresh folder under the one that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, label: str) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = named.rstrip("/") if named else tempfile.mkdtemp(prefix="marlstone-")
    return f"{root}/marlstone/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
