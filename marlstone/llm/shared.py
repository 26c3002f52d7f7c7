"""Tables written to the folder that driver and executors share.

The folder is the one the session names in ``spark.checkpoint.dir``. Only where
that setting is absent and driver and executors are one process (tests, a laptop)
is a local temporary folder used.
"""

from __future__ import annotations

import inspect
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: str | None = None


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reachable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver did; on a cluster ship it with ``--py-files`` or install it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    global _fallback
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _fallback is None:
        _fallback = tempfile.mkdtemp(prefix="marlstone-shared-")
    return _fallback


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/marlstone/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back.

    This cuts the lineage: a lost executor costs a re-read, never a recomputation
    of what came before.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.settled_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing still to be computed reads."""
    for table in tables:
        delete(table.sparkSession, table.settled_at)


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with neutral column names, which clash with none that an operator uses, and the new name of each old one."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(new).alias(old) for old, new in names.items()])


def clash_free(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let ``operator`` take tables whose columns have any names.

    Its table gets neutral names, its ``id_col``, ``text_col`` and ``keep`` are translated (by
    default all columns are kept), and the kept columns get their names back. A kept
    column that is named like a column the operator adds is replaced by that.
    """
    signature = inspect.signature(operator)

    @wraps(operator)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        given = signature.bind(df, *args, **options)
        given.apply_defaults()
        plain, names = renamed(df)
        keep = given.arguments.get("keep")
        keep = list(df.columns if keep is None else keep)
        columns = {k: names[v] for k, v in given.arguments.items() if k in ("id_col", "text_col")}
        if "keep" in given.arguments:
            columns["keep"] = [names[c] for c in keep]
        given.arguments |= columns | {next(iter(given.arguments)): plain}
        out = operator(*given.args, **given.kwargs)
        added = [c for c in out.columns if c not in names.values()]
        return out.select(*[F.col(names[c]).alias(c) for c in keep if c not in added and names[c] in out.columns], *[F.col(f"`{c}`") for c in added])

    return run


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cleanup(spark: SparkSession) -> None:
    """Delete every table this application settled. Results that still read them become invalid."""
    delete(spark, f"{shared_dir(spark)}/marlstone/{spark.sparkContext.applicationId}")
