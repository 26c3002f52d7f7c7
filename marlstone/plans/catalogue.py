"""One query for each operator, over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.predicates import TOLERANCE, Comparison, Predicate
from marlstone.functions.routing import shard_of
from marlstone.functions.statistics import exact_percentiles, padded_key, six_decimals, success_rate, throughput, unpadded_key
from marlstone.operators import select as selects
from marlstone.operators import workload
from marlstone.operators.aggregates import Aggregate
from marlstone.operators.history import bank_totals, check_bank, deltas, read_history, register_faults, self_transfers
from marlstone.operators.select import Join, Select
from marlstone.operators.transactions import Conflict, Transaction
from marlstone.plans.session import Session, SessionError
from marlstone.sources.catalog import TableDef
from marlstone.sources.generator import Scale, order_entry
from marlstone.sources.scratch import scratch_folder
from marlstone.sources.store import Store
from marlstone.sources.versions import key_range, latest, overlay, point, snapshot, text_range, tombstones, versions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey", "part": "p_partkey"}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def selected(spark: SparkSession, sf_dir: str, spec: Select, **options) -> DataFrame:
    names = [spec.table] + ([spec.join.table] if spec.join else [])
    return selects.run(spec, {n: table(spark, sf_dir, n) for n in names}, primary_keys={n: KEYS[n] for n in names if n in KEYS}, **options)


def spec_query(name: str, sql: str, spec: Select, **options) -> None:
    query(name, sql)(lambda spark, sf_dir: selected(spark, sf_dir, spec, **options))


# scans

query("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 42")(lambda s, d: point(table(s, d, "orders"), "o_orderkey", 42))
query("full_scan", "SELECT * FROM orders")(lambda s, d: table(s, d, "orders"))
query("range_scan_typed", "SELECT * FROM orders WHERE o_orderkey >= 9 AND o_orderkey < 110")(lambda s, d: key_range(table(s, d, "orders"), "o_orderkey", 9, 110))
query("range_scan_open", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 700")(lambda s, d: key_range(table(s, d, "orders"), "o_orderkey", 700).select("o_orderkey", "o_custkey"))
query("range_scan_text", "SELECT o_orderkey, o_totalprice FROM orders WHERE CAST(o_orderkey AS VARCHAR) >= '9' AND CAST(o_orderkey AS VARCHAR) < '91'")(
    lambda s, d: text_range(table(s, d, "orders"), "o_orderkey", "9", "91").select("o_orderkey", "o_totalprice")
)

# projections and filters

spec_query("select_star", "SELECT * FROM customer", Select("customer"))
spec_query("project_cols", "SELECT c_custkey, c_name FROM customer", Select("customer", ("c_custkey", "c_name")))
spec_query("project_qualified", "SELECT c_custkey, c_acctbal FROM customer", Select("customer", ("customer.c_custkey", "customer.c_acctbal")))
for _name, _op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    for _kind, _column, _value, _sql in (("int", "c_nationkey", 7, "7"), ("double", "c_acctbal", 1863.84, "1863.84::DOUBLE"), ("string", "c_mktsegment", "BUILDING", "'BUILDING'")):
        spec_query(
            f"filter_{_name}_{_kind}",
            f"SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE {_column} {_op} {_sql}",
            Select("customer", ("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), where=(Predicate(_column, _op, _value),)),
        )
spec_query(
    "filter_and",
    "SELECT c_custkey FROM customer WHERE c_nationkey >= 5 AND c_nationkey < 15 AND c_acctbal > 0::DOUBLE AND c_mktsegment <> 'BUILDING'",
    Select("customer", ("c_custkey",), where=(Predicate("c_nationkey", ">=", 5), Predicate("c_nationkey", "<", 15), Predicate("c_acctbal", ">", 0.0), Predicate("c_mktsegment", "!=", "BUILDING"))),
)
spec_query("filter_contradiction", "SELECT c_custkey FROM customer WHERE c_custkey > 10 AND c_custkey < 5", Select("customer", ("c_custkey",), where=(Predicate("c_custkey", ">", 10), Predicate("c_custkey", "<", 5))))
spec_query(
    "filter_float_eps",
    "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE abs(l_discount - 0.05::DOUBLE) < 1e-9::DOUBLE",
    Select("lineitem", ("l_orderkey", "l_linenumber", "l_discount"), where=(Predicate("l_discount", "=", 0.05),)),
    comparison=Comparison(tolerance=TOLERANCE),
)
spec_query("filter_int_truncated", "SELECT c_custkey FROM customer WHERE c_nationkey = 2", Select("customer", ("c_custkey",), where=(Predicate("c_nationkey", "=", 2.5),)), comparison=Comparison(truncate=True))
spec_query("filter_unparseable", "SELECT c_custkey FROM customer WHERE c_nationkey <> TRY_CAST('abc' AS DOUBLE)", Select("customer", ("c_custkey",), where=(Predicate("c_nationkey", "<>", "abc"),)))

# joins

for _strategy, _name in (("broadcast", "broadcast"), ("shuffle", "shuffle"), ("merge", "merge"), ("auto", "auto")):
    spec_query(
        f"inner_join_{_name}",
        "SELECT l_orderkey, l_linenumber, l_quantity, o_custkey, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 100000::DOUBLE",
        Select("lineitem", ("l_orderkey", "l_linenumber", "l_quantity", "o_custkey", "o_totalprice"), Join("orders", "l_orderkey", "o_orderkey", _strategy), (Predicate("o_totalprice", ">", 100000.0),)),
    )
spec_query(
    "join_reversed_on",
    "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    Select("orders", ("o_orderkey", "c_name"), Join("customer", "customer.c_custkey", "orders.o_custkey")),
)
spec_query(
    "join_where",
    "SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3",
    Select("orders", ("o_orderkey", "o_totalprice", "c_name"), Join("customer", "o_custkey", "c_custkey"), (Predicate("customer.c_nationkey", "=", 3),)),
)
spec_query(
    "join_agg",
    "SELECT count(*) AS count, coalesce(sum(o_custkey), 0)::BIGINT AS sum, coalesce(max(o_totalprice), 0) AS max FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3",
    Select("orders", (Aggregate("count"), Aggregate("sum", "o_custkey"), Aggregate("max", "o_totalprice")), Join("customer", "o_custkey", "c_custkey"), (Predicate("c_nationkey", "=", 3),)),
)
FLAGSHIP = Select("orders", ("o_orderkey", "o_totalprice", "c_name", "c_nationkey"), Join("customer", "o_custkey", "c_custkey"), (Predicate("c_nationkey", ">=", 3), Predicate("o_totalprice", ">", 100000.0)), "o_orderkey", True, 50)
spec_query(
    "join_order_limit",
    "SELECT o_orderkey, o_totalprice, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey >= 3 AND o_totalprice > 100000::DOUBLE ORDER BY o_orderkey DESC LIMIT 50",
    FLAGSHIP,
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(spark, sf_dir, FLAGSHIP)


# order and limit

spec_query("order_typed_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 25", Select("orders", ("o_orderkey", "o_totalprice"), order_by="o_orderkey", descending=True, limit=25))
spec_query("order_asc", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey", Select("orders", ("o_orderkey", "o_custkey"), order_by="o_custkey"))
spec_query(
    "order_text_desc_limit",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY CAST(o_orderkey AS VARCHAR) DESC LIMIT 25",
    Select("orders", ("o_orderkey", "o_totalprice"), order_by="o_orderkey", descending=True, limit=25),
    text_order=True,
)
spec_query("limit_in_key_order", "SELECT o_orderkey FROM orders ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 10", Select("orders", ("o_orderkey",), limit=10))
spec_query("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0", Select("orders", ("o_orderkey",), limit=0))
spec_query(
    "limit_then_agg",
    "SELECT count(*) AS count, sum(o_custkey)::BIGINT AS sum FROM (SELECT * FROM orders ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 7)",
    Select("orders", (Aggregate("count"), Aggregate("sum", "o_custkey")), limit=7),
)

# aggregates

spec_query("count_star", "SELECT count(*) AS count FROM lineitem", Select("lineitem", (Aggregate("count"),)))
spec_query("count_nonempty", "SELECT count(*) FILTER (WHERE length(c_mktsegment) > 0) AS count FROM customer", Select("customer", (Aggregate("count", "c_mktsegment"),)))
spec_query("count_column", "SELECT count(c_nationkey) AS count FROM customer", Select("customer", (Aggregate("count", "c_nationkey"),)))
spec_query("sum", "SELECT coalesce(sum(l_linenumber), 0)::BIGINT AS sum FROM lineitem", Select("lineitem", (Aggregate("sum", "l_linenumber"),)))
spec_query("min", "SELECT coalesce(min(o_totalprice), 0) AS min FROM orders", Select("orders", (Aggregate("min", "o_totalprice"),)))
spec_query("max", "SELECT coalesce(max(o_totalprice), 0) AS max FROM orders", Select("orders", (Aggregate("max", "o_totalprice"),)))
spec_query(
    "multi_agg",
    "SELECT count(*) AS count, sum(l_linenumber)::BIGINT AS sum, min(l_quantity) AS min, max(l_quantity) AS max, max(l_orderkey) AS max_2 FROM lineitem WHERE l_quantity > 25::DOUBLE",
    Select("lineitem", (Aggregate("count"), Aggregate("sum", "l_linenumber"), Aggregate("min", "l_quantity"), Aggregate("max", "l_quantity"), Aggregate("max", "l_orderkey")), where=(Predicate("l_quantity", ">", 25.0),)),
)
spec_query(
    "agg_empty_zero",
    "SELECT 0::BIGINT AS count, 0::BIGINT AS sum, 0::DOUBLE AS min, 0::DOUBLE AS max",
    Select("orders", (Aggregate("count"), Aggregate("sum", "o_custkey"), Aggregate("min", "o_totalprice"), Aggregate("max", "o_totalprice")), where=(Predicate("o_orderkey", "<", -1),)),
)
spec_query(
    "agg_first_row",
    "SELECT arg_max(o_orderkey, CAST(o_orderkey AS VARCHAR)) AS o_orderkey, count(*) AS count FROM orders",
    Select("orders", ("o_orderkey", Aggregate("count")), order_by="o_orderkey", descending=True),
    text_order=True,
)
spec_query(
    "agg_first_row_typed",
    "SELECT arg_min(o_custkey, o_orderkey) AS o_custkey, max(o_totalprice) AS max FROM orders WHERE o_orderkey >= 100",
    Select("orders", ("o_custkey", Aggregate("max", "o_totalprice")), where=(Predicate("o_orderkey", ">=", 100),), order_by="o_orderkey"),
)

# writes, as versions on top of a table and the snapshot that follows

ROW = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def rewritten(base: DataFrame, changed: DataFrame, deleted: bool = False) -> DataFrame:
    """``base`` after the versions of ``changed``; rows that don't change are not dealt again if those are few."""
    newer = latest(versions(changed, "o_orderkey", 2, deleted))
    return overlay(versions(base, "o_orderkey", 1), newer).select(*base.columns)


@query("update_add", f"SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 10 = 3 THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders")
def update_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = orders(spark, sf_dir)
    return rewritten(base, base.where("o_orderkey % 10 = 3").withColumn("o_totalprice", F.col("o_totalprice") + 100))


@query("update_sub", "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey = 17 THEN o_totalprice - 50.5::DOUBLE ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders")
def update_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = orders(spark, sf_dir)
    return rewritten(base, point(base, "o_orderkey", 17).withColumn("o_totalprice", F.col("o_totalprice") - 50.5))


@query("update_literal", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey < 100 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def update_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = orders(spark, sf_dir)
    return rewritten(base, base.where("o_orderkey < 100").withColumn("o_orderstatus", F.lit("X")))


@query("update_no_match", f"SELECT {ROW} FROM orders")
def update_no_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = orders(spark, sf_dir)
    return rewritten(base, point(base, "o_orderkey", -1).withColumn("o_totalprice", F.lit(0.0)))


@query("delete_row", f"SELECT {ROW} FROM orders WHERE o_orderkey <> 42")
def delete_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = orders(spark, sf_dir)
    return rewritten(base, point(base, "o_orderkey", 42), deleted=True)


@query(
    "insert_upsert",
    f"SELECT {ROW} FROM orders WHERE o_orderkey <> 5 UNION ALL SELECT 5, 1, 'N', 9.5, TIMESTAMP '1998-02-03 04:05:06', '1-URGENT' UNION ALL SELECT -7, 2, 'N', 10.5, NULL, '2-HIGH'",
)
def insert_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = orders(spark, sf_dir)
    new = spark.sql("SELECT * FROM VALUES (5L, 1L, 'N', 9.5D, TIMESTAMP_NTZ '1998-02-03 04:05:06', '1-URGENT'), (-7L, 2L, 'N', 10.5D, NULL, '2-HIGH') AS t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)")
    return rewritten(base, new)


# snapshots

LOG_SQL = """WITH log AS (
  SELECT *, 10 AS ts, false AS del FROM orders
  UNION ALL SELECT * REPLACE (o_totalprice + 1 AS o_totalprice), 20, false FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT *, 30, true FROM orders WHERE o_orderkey % 7 = 0),
seen AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY ts DESC) AS rn FROM log WHERE ts <= {ts})
SELECT * EXCLUDE (ts, del, rn) FROM seen WHERE rn = 1 AND NOT del"""


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = orders(spark, sf_dir)
    log = versions(base, "o_orderkey", 10).unionByName(versions(base.where("o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1), "o_orderkey", 20))
    return log.unionByName(tombstones(base.where("o_orderkey % 7 = 0").select("o_orderkey"), log, "o_orderkey", 30))


for _name, _ts in (("snapshot_before_all", 5), ("snapshot_asof", 25), ("snapshot_tombstone", 35)):
    query(_name, LOG_SQL.format(ts=_ts))(lambda s, d, ts=_ts: snapshot(order_log(s, d), ts))


@query("snapshot_range", LOG_SQL.format(ts=25) + " AND o_orderkey >= 100 AND o_orderkey < 200")
def snapshot_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(key_range(order_log(spark, sf_dir), "o_orderkey", 100, 200), 25)


# transactions


@query(
    "txn_overlay",
    """SELECT * REPLACE (CASE WHEN o_orderkey % 100 = 1 THEN o_totalprice + 5 ELSE o_totalprice END AS o_totalprice)
FROM orders WHERE o_orderkey % 100 <> 2 UNION ALL SELECT -1, NULL, NULL, 77.5, NULL, NULL""",
)
def txn_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot under an open transaction's update, delete and fresh insert."""
    base = orders(spark, sf_dir)
    buffer = versions(base.where("o_orderkey % 100 = 1").withColumn("o_totalprice", F.col("o_totalprice") + 5), "o_orderkey", 1)
    buffer = buffer.unionByName(versions(base.where("o_orderkey % 100 = 2"), "o_orderkey", 2, deleted=True))
    buffer = buffer.unionByName(versions(spark.sql("SELECT -1L AS o_orderkey, 77.5D AS o_totalprice"), "o_orderkey", 3), allowMissingColumns=True).select(*buffer.columns)
    return overlay(versions(base, "o_orderkey", 0), latest(buffer)).select(*base.columns)


@query("txn_conflict", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 = 0")
def txn_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys a transaction read (multiples of 3) that have versions newer than its snapshot (multiples of 5)."""
    log = order_log(spark, sf_dir)
    read = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", F.col("o_orderkey").cast("string").alias("_pk"))
    newer = log.where("_commit_ts > 15 AND NOT _deleted").select("_pk")
    return read.join(newer, "_pk", "left_semi").select("o_orderkey")


def order_store(spark: SparkSession, sf_dir: str, shards: int = 1) -> Store:
    store = Store(spark, scratch_folder(spark, "store"))
    base = orders(spark, sf_dir)
    store.create_table(TableDef.from_schema("orders", base.schema, "o_orderkey", shards))
    store.bulk_load("orders", base)
    return store


@query("txn_rollback", f"SELECT {ROW} FROM orders")
def txn_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = order_store(spark, sf_dir)
    t = Transaction.begin(store)
    t.update("orders", {"o_totalprice": F.lit(0.0)}, F.col("o_orderkey") < 50)
    t.delete("orders", key=60)
    t.rollback()
    return store.read("orders")


@query(
    "txn_commit",
    "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey = 3 THEN o_totalprice + 10 WHEN o_orderkey = 4 THEN o_totalprice - 10 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey <> 5",
)
def txn_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two updates and a delete in one transaction over sharded files; a second one that read a changed key is refused."""
    store = order_store(spark, sf_dir, shards=4)
    first, second = Transaction.begin(store), Transaction.begin(store)
    second.update("orders", {"o_totalprice": F.lit(-1.0)}, key=3)
    first.update("orders", {"o_totalprice": F.col("o_totalprice") + 10}, key=3)
    first.update("orders", {"o_totalprice": F.col("o_totalprice") - 10}, key=4)
    first.delete("orders", key=5)
    first.commit()
    try:
        second.commit()
    except Conflict:
        return store.read("orders")
    raise AssertionError("the second transaction should have been refused")


@query(
    "session_script",
    """SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM (
SELECT o_orderkey, CASE WHEN o_orderkey = 8 THEN 999 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey = 8 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate FROM orders WHERE o_orderkey <> 9
UNION ALL SELECT 100000007, 1, 5.5, TIMESTAMP '1998-02-03 04:05:06') WHERE o_totalprice < 50000::DOUBLE""",
)
def session_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements as text, in and outside a transaction, and a lazy SELECT of what they leave."""
    session = Session(order_store(spark, sf_dir))
    session.execute(
        """BEGIN; UPDATE orders SET o_custkey = 999, o_totalprice = o_totalprice + 1 WHERE o_orderkey = 8; DELETE FROM orders WHERE o_orderkey = 9; COMMIT;
        INSERT INTO orders (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority) VALUES (100000007, 1, 'O', 5.5, '1998-02-03 04:05:06', 'it''s;low');
        BEGIN; DELETE FROM orders WHERE o_orderkey = 10; ROLLBACK"""
    )
    return session.query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_totalprice < 50000.0")


@query(
    "session_prepared",
    "SELECT o_orderkey, CASE WHEN o_orderkey IN (1, 2) THEN 'P' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey <> 6",
)
def session_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements prepared once and run with several values."""
    store = order_store(spark, sf_dir)
    session = Session(store)
    session.prepare("mark", "UPDATE orders SET o_orderstatus = $2 WHERE o_orderkey = $1")
    session.prepare("drop", "DELETE FROM orders WHERE o_orderkey = $1")
    for name, values in (("mark", [1, "P"]), ("mark", [2, "P"]), ("drop", [6])):
        session.bind(name, values)
        session.execute_portal()
    return session.query("SELECT o_orderkey, o_orderstatus FROM orders")


@query(
    "txn_two_tables",
    """SELECT 'orders' AS name, o_orderkey AS key, o_totalprice - 25 AS value FROM orders WHERE o_orderkey IN (11, 12)
UNION ALL SELECT 'customer', c_custkey, c_acctbal + 50 FROM customer WHERE c_custkey = 3
UNION ALL SELECT 'rows', 0, CAST((SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) AS DOUBLE)""",
)
def txn_two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit over two tables, seen whole by a reader that opens the store anew."""
    store = order_store(spark, sf_dir)
    customers = table(spark, sf_dir, "customer")
    store.create_table(TableDef.from_schema("customer", customers.schema, "c_custkey"))
    store.bulk_load("customer", customers)
    t = Transaction.begin(store)
    t.update("orders", {"o_totalprice": F.col("o_totalprice") - 25}, F.col("o_orderkey").isin(11, 12))
    t.update("customer", {"c_acctbal": F.col("c_acctbal") + 50}, key=3)
    t.commit()
    again = Store(spark, store.root)
    one, other = again.read("orders"), again.read("customer")
    changed = one.where("o_orderkey IN (11, 12)").selectExpr("'orders' AS name", "o_orderkey AS key", "o_totalprice AS value")
    changed = changed.unionByName(other.where("c_custkey = 3").selectExpr("'customer' AS name", "c_custkey AS key", "c_acctbal AS value"))
    whole = one.selectExpr("1 AS x").unionByName(other.selectExpr("1 AS x")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return changed.unionByName(whole.selectExpr("'rows' AS name", "0L AS key", "value"))


@query(
    "txn_own_writes",
    f"""SELECT {ROW} FROM (SELECT * REPLACE (CASE WHEN o_orderkey = 3 THEN o_totalprice + 2 ELSE o_totalprice END AS o_totalprice) FROM orders WHERE o_orderkey <> 4
UNION ALL SELECT -5, 7, 'N', 3.5, TIMESTAMP '1998-02-03 04:05:06', 'x') WHERE o_orderkey < 1000""",
)
def txn_own_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an open transaction sees of its own update, delete and insert, in a range and by key."""
    t = Transaction.begin(order_store(spark, sf_dir, shards=2))
    for _ in range(2):
        t.update("orders", {"o_totalprice": F.col("o_totalprice") + 1}, key=3)
    t.delete("orders", key=4)
    t.insert("orders", {"o_orderkey": -5, "o_custkey": 7, "o_orderstatus": "N", "o_totalprice": 3.5, "o_orderdate": "1998-02-03 04:05:06", "o_orderpriority": "x"})
    seen = key_range(t.scan("orders"), "o_orderkey", high=1000)
    return seen.where("o_orderkey <> 3").unionByName(t.get("orders", 3)).unionByName(t.get("orders", 4))


@query("store_after_crash", f"SELECT {ROW} FROM orders")
def store_after_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a writer that died before its manifest are not there for a reader that opens the store anew."""
    store = order_store(spark, sf_dir)
    lost = versions(table(spark, sf_dir, "orders").withColumn("o_totalprice", F.lit(0.0)), "o_orderkey", 99)
    store.write_files(store.manifest().catalog.get("orders"), lost)
    return Store(spark, store.root).read("orders")


@query("store_compacted", "SELECT * REPLACE (CASE WHEN o_orderkey < 20 THEN 'C' ELSE o_orderstatus END AS o_orderstatus) FROM orders WHERE o_orderkey <> 30")
def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose versions were merged into one folder and then folded into its base."""
    store = order_store(spark, sf_dir)
    for change in (lambda t: t.update("orders", {"o_orderstatus": F.lit("C")}, F.col("o_orderkey") < 20), lambda t: t.delete("orders", key=30)):
        t = Transaction.begin(store)
        change(t)
        t.commit()
    store.merge_deltas("orders", most=1)
    store.compact("orders")
    return Store(spark, store.root).read("orders")


@query("session_create", "SELECT * FROM (VALUES (1, 'it''s', 2.5::DOUBLE, 10000000000::BIGINT), (2, 'b', -0.5::DOUBLE, 7::BIGINT)) t(id, name, price, big)")
def session_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table declared and filled by text; one made inside a transaction goes with its rollback."""
    session = Session(Store(spark, scratch_folder(spark, "store")))
    session.execute(
        """CREATE TABLE items (id INT PRIMARY KEY, name VARCHAR(20), price FLOAT, big BIGINT);
        BEGIN; CREATE TABLE gone (id INT PRIMARY KEY); INSERT INTO gone (id) VALUES (1); ROLLBACK;
        CREATE TABLE gone (id INT PRIMARY KEY);
        INSERT INTO items (id, name, price, big) VALUES (1, 'it''s', 2.5, 10000000000);
        INSERT INTO items (id, name, price, big) VALUES (2, 'a', 0.5, 6); INSERT INTO items (id, name, price, big) VALUES (2, 'b', -0.5, 7)"""
    )
    return session.query("SELECT * FROM items")


@query("session_describe", "SELECT * FROM (VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_totalprice', 'double'), (2, 'o_orderdate', 'timestamp_ntz'), (3, 'c_name', 'string')) t(position, name, type)")
def session_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a prepared join, known without running it."""
    store = order_store(spark, sf_dir)
    store.create_table(TableDef.from_schema("customer", table(spark, sf_dir, "customer").schema, "c_custkey"))
    session = Session(store)
    session.prepare("q", "SELECT o_orderkey, o_totalprice, o_orderdate, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = $1")
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(session.describe("q"))]
    return spark.createDataFrame(rows, "position int, name string, type string")


@query(
    "session_states",
    """SELECT * FROM (VALUES (0, 'I', '42601'), (1, 'T', 'BEGIN'), (2, 'T', 'INSERT 0 1'), (3, 'E', 'XX000'), (4, 'E', '25P02'), (5, 'E', '25P02'), (6, 'I', 'ROLLBACK'), (7, 'I', 'SELECT 0'),
(8, 'I', 'XX000'), (9, 'T', 'BEGIN'), (10, 'T', 'UPDATE 0'), (11, 'I', 'COMMIT')) t(step, status, outcome)""",
)
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each statement's tag or SQLSTATE and the status that follows: errors outside and inside a transaction, and the way out."""
    session = Session(Store(spark, scratch_folder(spark, "store")))
    session.execute("CREATE TABLE t (id INT PRIMARY KEY, v INT)")
    script = ["SELEC 1", "BEGIN", "INSERT INTO t (id, v) VALUES (1, 1)", "SELECT nope FROM t", "SELECT * FROM t", "COMMIT", "ROLLBACK", "SELECT * FROM t", "COMMIT", "BEGIN", "UPDATE t SET v = v + 1 WHERE id = 1", "COMMIT"]
    rows = []
    for step, sql in enumerate(script):
        try:
            outcome = session.execute(sql)[0].tag
        except SessionError as e:
            outcome = e.sqlstate
        rows.append((step, session.status, outcome))
    return spark.createDataFrame(rows, "step int, status string, outcome string")


# routing, workload tables and figures


@query(
    "workload_run",
    """SELECT * FROM (VALUES ('balance', 210.0::DOUBLE, 20::BIGINT), ('district', 30100.0::DOUBLE, 1::BIGINT), ('next_order', 2.0::DOUBLE, 1::BIGINT), ('warehouse', 300200.0::DOUBLE, 1::BIGINT)) t(name, value, n)""",
)
def workload_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five order-entry transactions at the usual scale, once each with amount 100: what they left in the tables.

    ``balance`` sums what customers 5 to 14 of a district have beyond a payment, over the districts of both warehouses.
    """
    store, scale = Store(spark, scratch_folder(spark, "workload")), Scale()
    workload.load(store, scale)
    choice = workload.Choice(1, 1, 6, 3, 100.0, tuple(range(5, 15)))
    for kind in workload.RUNS:
        if not workload.run_one(store, kind, choice, scale):
            raise AssertionError(f"{kind} did not commit")
    total = lambda name, rows, value: rows.agg(F.lit(name).alias("name"), F.sum(value).cast("double").alias("value"), F.count(F.lit(1)).alias("n"))
    balances = store.read("customer").where("c_id % 10000 - c_d_id = 5").select((F.col("c_balance") + 20.0 + F.when(F.col("c_id") == 110006, 100.0).otherwise(0.0)).alias("b"))
    district, house = point(store.read("district"), "d_id", 11), point(store.read("warehouse"), "w_id", 1)
    parts = [total("balance", balances, "b"), total("district", district, "d_ytd"), total("next_order", district, "d_next_o_id"), total("warehouse", house, "w_ytd")]
    return reduce(DataFrame.unionByName, parts)


@query("workload_mix", "SELECT * FROM (VALUES ('new_order', 5, 5), ('payment', 2, 2), ('order_status', 1, 1)) t(kind, runs, committed)")
def workload_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions drawn by the standard mix from a fixed seed, and how many of each kind committed."""
    store, scale = Store(spark, scratch_folder(spark, "workload")), Scale(1, 2, 3, 4)
    workload.load(store, scale)
    report = workload.run_mix(store, 8, seed=1, scale=scale)
    return spark.createDataFrame([(kind, len(taken), report.committed.get(kind, 0)) for kind, taken in report.latencies.items()], "kind string, runs int, committed int")


@query(
    "shard_histogram",
    """SELECT shard, count(*) AS keys FROM (
SELECT CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(generate_series(1, length(k)), lambda i: CAST(ascii(k[i]) AS HUGEINT))),
  lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) % 3 AS INTEGER) AS shard
FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders)) GROUP BY shard""",
)
def shard_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").select(shard_of(F.col("o_orderkey").cast("string"), 3).alias("shard"))
    return keys.groupBy("shard").agg(F.count(F.lit(1)).alias("keys"))


query("parse_pk", "SELECT o_orderkey, CAST(lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS BIGINT) AS key FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", unpadded_key(padded_key(F.col("o_orderkey"))).alias("key"))
)
query("value_text", "SELECT o_orderkey, printf('%.6f', o_totalprice) AS text FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", six_decimals(F.col("o_totalprice")).alias("text")))
query("format_pk", "SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS pk FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", padded_key(F.col("o_orderkey")).alias("pk")))


WORKLOAD_SQL = """WITH w AS (SELECT unnest(generate_series(1, 2)) AS w), d AS (SELECT w, unnest(generate_series(0, 9)) AS d FROM w), c AS (SELECT w, d, unnest(generate_series(1, 100)) AS c FROM d),
i AS (SELECT w, unnest(generate_series(1, 1000)) AS i FROM w)
SELECT 'warehouse' AS name, w AS key, concat_ws('|', 'WH-' || w, 300000.0) AS rest FROM w
UNION ALL SELECT 'district', w * 10 + d, concat_ws('|', w, 'DIST-' || w || '-' || d, 1, 30000.0) FROM d
UNION ALL SELECT 'customer', w * 100000 + d * 10000 + c, concat_ws('|', d, w, 'CUST-' || c, -10.0) FROM c
UNION ALL SELECT 'orders', w * 100000000 + d * 1000000 + c, concat_ws('|', d, w, c, 0) FROM c
UNION ALL SELECT 'order_line', w * 100000000 + d * 1000000 + c, concat_ws('|', w * 100000000 + d * 1000000 + c, c % 1000 + 1, 5, 10.0) FROM c
UNION ALL SELECT 'stock', w * 10000 + i, concat_ws('|', w, i, 100) FROM i"""


@query("workload_tables", WORKLOAD_SQL)
def workload_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the six tables: its key and its other columns."""
    parts = [df.select(F.lit(name).alias("name"), F.col(df.columns[0]).cast("long").alias("key"), F.concat_ws("|", *df.columns[1:]).alias("rest")) for name, df in order_entry(spark).items()]
    return reduce(DataFrame.unionByName, parts)


def event_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("src"), (F.col("user_id") + 1).cast("string").alias("dst"), (F.col("event_id") % 5 + 1).alias("amount"))


query(
    "bank_deltas",
    """SELECT account, sum(delta)::BIGINT AS delta FROM (
SELECT CAST(user_id AS VARCHAR) AS account, -(event_id % 5 + 1) AS delta FROM events UNION ALL SELECT CAST(user_id + 1 AS VARCHAR), event_id % 5 + 1 FROM events) GROUP BY account""",
)(lambda s, d: deltas(event_transfers(s, d)))
BANK_SQL = """touched AS (SELECT CAST(user_id AS VARCHAR) AS account FROM events UNION SELECT CAST(user_id + 1 AS VARCHAR) FROM events),
deltas AS (SELECT user_id AS account, -(event_id % 5 + 1) AS delta FROM events UNION ALL SELECT user_id + 1, event_id % 5 + 1 FROM events),
sums AS (SELECT accounts, accounts * 1000 + 1000 * (SELECT count(*) FROM touched WHERE CAST(account AS BIGINT) >= accounts) + (SELECT sum(delta) FROM deltas) AS total FROM (VALUES (5), (100), (5000)) t(accounts))"""


@query("bank_conservation", f"WITH {BANK_SQL} SELECT CAST(accounts AS INTEGER) AS accounts, CAST(total AS BIGINT) AS total, CAST(accounts * 1000 AS BIGINT) AS expected FROM sums")
def bank_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All balances against what the declared accounts began with, for too few declared accounts and for enough."""
    moves = event_transfers(spark, sf_dir)
    return reduce(DataFrame.unionByName, [bank_totals(moves, n, 1000).select(F.lit(n).alias("accounts"), "total", "expected") for n in (5, 100, 5000)])


@query("bank_check", f"WITH {BANK_SQL} SELECT CAST(accounts AS INTEGER) AS accounts, total = accounts * 1000 AS ok FROM sums")
def bank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on a history of transfers, read from its JSON lines; it is refused where a transfer touches an account that was not declared."""
    value = F.array("src", "dst", F.col("amount").cast("string"))
    history = event_transfers(spark, sf_dir).select(F.lit(0).cast("long").alias("time_us"), F.lit(0).alias("process"), F.lit("ok").alias("type"), F.lit("transfer").alias("f"), value.alias("value"))
    path = scratch_folder(spark, "history")
    history.write.json(path)
    written = read_history(spark, path)
    return spark.createDataFrame([(n, check_bank(written, n, 1000).ok) for n in (5, 100, 5000)], "accounts int, ok boolean")


@query(
    "register_check",
    """WITH ops AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'write' ELSE 'read' END AS f, CAST(user_id AS VARCHAR) AS register, CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 4 ELSE event_id % 5 END AS VARCHAR) AS value FROM events),
vals AS (SELECT register, value, max(CASE WHEN f = 'write' THEN 1 ELSE 0 END) AS written FROM ops GROUP BY register, value)
SELECT register, CAST(sum(1 - written) AS BIGINT) AS unwritten FROM vals GROUP BY register HAVING sum(1 - written) > 1""",
)
def register_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers whose reads and writes, made up from events, fit no serial order."""
    e = table(spark, sf_dir, "events")
    wrote = F.col("event_id") % 3 == 0
    value = F.when(wrote, F.col("event_id") % 4).otherwise(F.col("event_id") % 5).cast("string")
    history = e.select(
        F.col("event_id").alias("time_us"), F.lit(0).alias("process"), F.lit("ok").alias("type"), F.when(wrote, "write").otherwise("read").alias("f"), F.array(F.col("user_id").cast("string"), value).alias("value")
    )
    return register_faults(history)


query("self_transfers", "SELECT CAST(user_id AS VARCHAR) AS src, CAST(user_id AS VARCHAR) AS dst, event_id % 5 + 1 AS amount FROM events WHERE user_id % 2 = 0")(
    lambda s, d: self_transfers(event_transfers(s, d).withColumn("dst", F.when(F.col("src").cast("long") % 2 == 0, F.col("src")).otherwise(F.col("dst"))))
)
query(
    "latency_percentile",
    """SELECT event_type, v[least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) + 1] AS p50, v[least(n - 1, CAST(floor(0.95 * n) AS BIGINT)) + 1] AS p95, v[least(n - 1, CAST(floor(0.99 * n) AS BIGINT)) + 1] AS p99
FROM (SELECT event_type, list_sort(list(value)) AS v, count(value) AS n FROM events GROUP BY event_type)""",
)(lambda s, d: exact_percentiles(table(s, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}))


@query(
    "success_rate",
    """SELECT o_orderpriority, CASE WHEN count(*) = 0 THEN 0 ELSE 100.0::DOUBLE * count(*) FILTER (WHERE o_orderstatus <> 'P') / count(*) END AS success_rate,
count(*) FILTER (WHERE o_orderstatus <> 'P') / 30.0::DOUBLE AS per_second FROM orders GROUP BY o_orderpriority""",
)
def success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, lost = F.count_if(F.col("o_orderstatus") != "P"), F.count_if(F.col("o_orderstatus") == "P")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(success_rate(done, lost).alias("success_rate"), throughput(done, F.lit(30.0)).alias("per_second"))
