"""Figures over runs: exact percentiles, success rates and throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Ranks of the sketch are off by one in so many at most; a bracket holds about twice that share of a group.
SKETCH_ACCURACY = 10_000


def exact_percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float], accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """By group, the element at ``min(n - 1, floor(share * n))`` of the ascending values; nulls are left out.

    A mergeable sketch brackets each wanted rank between two values first. What lies
    below a bracket is only counted, with partial counts before the exchange; ranks are
    worked out among the values of the bracket, so no window holds a group's values but
    about two in ``accuracy`` of them, repeated values counted as one row.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("_group"), F.col(value).alias("_value"))
    slack, names = 2 / accuracy, list(shares)
    edges = [min(1.0, max(0.0, share + side * slack)) for share in shares.values() for side in (-1, 1)]
    sketch = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_value", edges, accuracy).alias("_edges"))
    wanted = sketch.select(
        F.col("_group").alias("_of"),
        F.inline(
            F.array(*[
                F.struct(
                    F.lit(i).alias("_share"), F.least(F.col("_n") - 1, F.floor(F.lit(share) * F.col("_n"))).alias("_rank"), F.col("_edges")[2 * i].alias("_low"), F.col("_edges")[2 * i + 1].alias("_high")
                )
                for i, share in enumerate(shares.values())
            ])
        ),
    )
    met = rows.join(wanted, F.col("_group").eqNullSafe(F.col("_of"))).select("_group", "_share", "_rank", "_low", "_value", "_high").where("_value <= _high")
    # one row for all that lies below the bracket, one for each value in it
    counted = met.groupBy("_group", "_share", "_rank", F.when(F.col("_value") >= F.col("_low"), F.col("_value")).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = counted.selectExpr("*", "sum(_n) over (partition by _group, _share order by _value asc nulls first) as _upto")
    hit = ranked.where("_value IS NOT NULL AND _upto > _rank").groupBy("_group")
    return hit.agg(*[F.min(F.when(F.col("_share") == i, F.col("_value"))).alias(name) for i, name in enumerate(names)]).withColumnRenamed("_group", group)


def success_rate(committed: Column, aborted: Column) -> Column:
    """Percent of attempts that committed; 0 without attempts."""
    total = committed + aborted
    return F.when(total == 0, F.lit(0.0)).otherwise(F.lit(100.0) * committed / total)


def throughput(committed: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, committed / seconds).otherwise(F.lit(0.0))


def padded_key(key: Column, width: int = 10) -> Column:
    """A non-negative integer key as text whose order is the number's."""
    return F.lpad(key.cast("string"), width, "0")


def unpadded_key(key: Column) -> Column:
    return key.cast("bigint")


def six_decimals(value: Column) -> Column:
    """A double as text with six decimals, for display; never compare such text."""
    return F.format_string("%.6f", value)
