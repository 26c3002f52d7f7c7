"""Version logs as streams: commits that arrive over time, folded into the newest row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_changes(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """New version files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def latest_changes(changes: DataFrame) -> DataFrame:
    """The newest version of each key so far; run it in output mode complete or update."""
    rest = [c for c in changes.columns if c != "_pk"]
    newest = changes.groupBy("_pk").agg(F.max_by(F.struct(*rest), F.col("_commit_ts")).alias("_row"))
    return newest.select("_pk", "_row.*")
