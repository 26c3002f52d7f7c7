"""Inner equi-joins with a choice of physical strategy."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DatetimeType, DayTimeIntervalType, DecimalType, NullType, NumericType, StringType, StructField, YearMonthIntervalType

#: A side is broadcast on request only if its rows take at most this in a hash table.
MAX_BROADCAST_BYTES = 512 << 20
#: And at most this part of the smallest heap: the driver holds a side as it comes in, in pages that double as they fill, and packed to be sent.
HEAP_PART = 16
#: Beyond this an estimate says that the optimizer knows nothing, as of rows that don't come from files.
UNKNOWN_BYTES = 1 << 50
#: Of a row in a hash table beside its columns: its header and its key's places, half of which or more stay free.
ENTRY_BYTES = 72
EIGHT_BYTES = (NumericType, BooleanType, DatetimeType, DayTimeIntervalType, YearMonthIntervalType, NullType)
STRATEGIES = ("auto", "broadcast", "shuffle", "merge")


def estimated_bytes(df: DataFrame) -> int:
    """By the optimizer: of files what they take on disk, which may be far less than their rows take in memory."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def variable_bytes(c: Column, f: StructField) -> Column | None:
    """What a column takes beside its eight bytes in a row, or a little more. Of nested values the text tells: no part takes over 16 times its text."""
    if isinstance(f.dataType, DecimalType):
        return F.lit(16)
    if isinstance(f.dataType, EIGHT_BYTES):
        return None
    size = F.octet_length(c) + 8 if isinstance(f.dataType, (StringType, BinaryType)) else 16 * (F.octet_length(c.cast("string")).cast("long") + 8)
    return F.coalesce(size, F.lit(0))


def hashed_bytes(df: DataFrame) -> int:
    """What all rows take in a broadcast hash table, without the free part of its pages, or somewhat more; counts in one job."""
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    parts = [variable_bytes(named[g.name], g) for g in named.schema]
    row = reduce(add, [p for p in parts if p is not None], F.lit(ENTRY_BYTES + 8 * len(parts) + 8 * (len(parts) // 64)).cast("long"))
    return named.agg(F.sum(row)).first()[0] or 0


def broadcast_bound(spark: SparkSession) -> int:
    """The most that a side may take in a hash table, which the driver makes and every executor holds."""
    context, jvm = spark.sparkContext, spark._jvm
    heaps = [jvm.java.lang.Runtime.getRuntime().maxMemory()]
    if not context._jsc.sc().isLocal():
        heaps.append(jvm.org.apache.spark.network.util.JavaUtils.byteStringAsMb(context.getConf().get("spark.executor.memory", "1g")) << 20)
    return min(MAX_BROADCAST_BYTES, min(heaps) // HEAP_PART)


def fits(df: DataFrame, bound: int) -> bool:
    """Whether the rows take at most ``bound`` in a hash table. What takes more as files is not counted."""
    estimate = estimated_bytes(df)
    return (estimate <= bound or estimate > UNKNOWN_BYTES) and hashed_bytes(df) <= bound


def inner_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, strategy: str = "auto") -> DataFrame:
    """Rows whose keys are equal, with the columns of both sides.

    ``auto`` leaves the choice to the optimizer and adaptive execution, which broadcast
    by measured size and split skewed partitions. ``broadcast`` sends the smaller side to
    all tasks if its rows, counted in a job of their own, fit a part of the driver's and the
    executors' memory (``broadcast_bound``), and joins as ``merge`` does otherwise: an
    estimate by files may be small where the rows are too large for the driver.
    ``shuffle`` and ``merge`` deal both sides by key and join by hash or sort.
    Null keys never match.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "broadcast":
        bound = broadcast_bound(left.sparkSession)
        sent = next((df for df in sorted([right, left], key=estimated_bytes) if fits(df, bound)), None)
        if sent is None:
            right = right.hint("merge")
        elif sent is left:
            left = F.broadcast(left)
        else:
            right = F.broadcast(right)
    elif strategy == "shuffle":
        right = right.hint("shuffle_hash")
    elif strategy == "merge":
        right = right.hint("merge")
    return left.join(right, left[left_col] == right[right_col], "inner")
