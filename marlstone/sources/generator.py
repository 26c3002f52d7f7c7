"""Deterministic tables of the order-entry workload, generated where they are used."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scale:
    warehouses: int = 2
    districts: int = 10
    customers: int = 100
    items: int = 1000


#: Fixed value: items of order lines repeat after so many customers.
LINE_ITEMS = 1000
PRIMARY_KEYS = {"warehouse": "w_id", "district": "d_id", "customer": "c_id", "orders": "o_id", "order_line": "ol_id", "stock": "s_id"}


def order_entry(spark: SparkSession, scale: Scale = Scale()) -> dict[str, DataFrame]:
    """Warehouses and customers count from 1, districts from 0; keys combine them in decimal places, other columns hold the plain numbers."""
    w, d, c = F.col("w"), F.col("d"), F.col("c")
    houses = spark.range(1, scale.warehouses + 1).select(F.col("id").alias("w"))
    numbers = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    districts = houses.select("w", numbers(scale.districts, "d"))
    customers = districts.select("w", "d", numbers(scale.customers, "c")).select("w", "d", (c + 1).alias("c"))
    integer = lambda x, name: x.cast("int").alias(name)
    order = w * 100_000_000 + d * 1_000_000 + c
    return {
        "warehouse": houses.select(integer(w, "w_id"), F.concat(F.lit("WH-"), w).alias("w_name"), F.lit(300000.0).alias("w_ytd")),
        "district": districts.select(integer(w * 10 + d, "d_id"), integer(w, "d_w_id"), F.concat_ws("-", F.lit("DIST"), w, d).alias("d_name"), F.lit(1).alias("d_next_o_id"), F.lit(30000.0).alias("d_ytd")),
        "customer": customers.select(
            integer(w * 100_000 + d * 10_000 + c, "c_id"), integer(d, "c_d_id"), integer(w, "c_w_id"), F.concat(F.lit("CUST-"), c).alias("c_name"), F.lit(-10.0).alias("c_balance")
        ),
        "orders": customers.select(integer(order, "o_id"), integer(d, "o_d_id"), integer(w, "o_w_id"), integer(c, "o_c_id"), F.lit(0).alias("o_carrier_id")),
        "order_line": customers.select(integer(order, "ol_id"), integer(order, "ol_o_id"), integer(c % LINE_ITEMS + 1, "ol_i_id"), F.lit(5).alias("ol_quantity"), F.lit(10.0).alias("ol_amount")),
        "stock": houses.select("w", numbers(scale.items, "i")).select(integer(w * 10_000 + F.col("i") + 1, "s_id"), integer(w, "s_w_id"), integer(F.col("i") + 1, "s_i_id"), F.lit(100).alias("s_quantity")),
    }
