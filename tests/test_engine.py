"""The store's operators: scans, filters, joins, order, aggregates, versions, transactions, sessions."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions.predicates import Comparison, Predicate, condition, leading_number
from marlstone.functions.routing import shard_of, shard_of_key
from marlstone.functions.statistics import exact_percentiles, padded_key, six_decimals, success_rate, unpadded_key
from marlstone.operators import workload
from marlstone.operators.aggregates import Aggregate
from marlstone.operators.history import check_bank, check_history, check_registers
from marlstone.operators.joins import broadcast_bound, estimated_bytes, hashed_bytes, inner_join
from marlstone.operators.select import Join, Select, run
from marlstone.operators.transactions import Conflict, Transaction
from marlstone.plans.grammar import Control, Delete, Insert, Shift, SqlError, Update, parse, split_statements
from marlstone.plans.session import Session, SessionError
from marlstone.sources.catalog import Catalog, ColumnDef, ColumnType, SchemaError, TableDef
from marlstone.sources.generator import Scale, order_entry
from marlstone.sources.store import Folder, Manifest, ManifestTaken, Store
from marlstone.sources.versions import key_range, snapshot, text_range, tombstones, versions


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


@pytest.fixture
def session(store):
    return Session(store)


def ids(result):
    return [tuple(r) for r in result.rows]


# grammar


def test_create():
    t = parse("CREATE TABLE t (id INT PRIMARY KEY, name VARCHAR(20), x float, y BIGINT)")
    assert t.primary_key == "id" and [c.type.value for c in t.columns] == ["INT", "VARCHAR", "FLOAT", "BIGINT"]


@pytest.mark.parametrize("bad", ["SELEC * FROM t", "CREATE TABLE t (id INT)", "SELECT FROM t", "SELECT * FROM t WHERE", "INSERT INTO t (a) VALUES (1, 2)", "SELECT * FROM t LIMIT -1",
                                 "SELECT SUM(*) FROM t", "CREATE TABLE t (id INT PRIMARY KEY, k INT NOT NULL)", "CREATE TABLE t (key INT PRIMARY KEY)", "SELECT * FROM t extra", "", "SELECT * FROM t WHERE a ~ 1"])
def test_syntax_errors(bad):
    with pytest.raises(SqlError):
        parse(bad)


def test_statements():
    assert parse("insert into T (ID, name) values (1, 'it''s')") == Insert("t", ("id", "name"), (1, "it's"))
    assert parse("UPDATE t SET balance = balance + 100 WHERE id = 1") == Update("t", (("balance", Shift("balance", 1, 100)),), (Predicate("id", "=", 1),))
    assert parse("DELETE FROM t WHERE id >= 10 AND id < 20") == Delete("t", (Predicate("id", ">=", 10), Predicate("id", "<", 20)))
    assert parse("abort") == Control("rollback")
    s = parse("SELECT a, COUNT(*), max(t.b) FROM t INNER JOIN u ON t.x = u.y WHERE t.c <> 'q' ORDER BY a DESC LIMIT 3 -- end")
    assert s == Select("t", ("a", Aggregate("count"), Aggregate("max", "t.b")), Join("u", "t.x", "u.y"), (Predicate("t.c", "<>", "q"),), "a", True, 3)


def test_split():
    assert split_statements("SELECT ';' ; -- a;b\n BEGIN;;") == ["SELECT ';'", "-- a;b\n BEGIN"]


# catalog


def test_catalog():
    c = Catalog()
    one = c.create(TableDef("a", (ColumnDef("id", ColumnType.INT),), "id"))
    assert one.table_id == 1 and c.by_id(1) is one
    with pytest.raises(SchemaError):
        c.create(one)
    with pytest.raises(SchemaError):
        TableDef("b", (ColumnDef("id", ColumnType.INT),), "no")
    assert TableDef.from_dict(one.to_dict()) == one


# predicates


@pytest.mark.parametrize("op,want", [("=", [2]), ("<>", [1, 3]), ("!=", [1, 3]), ("<", [1]), ("<=", [1, 2]), (">", [3]), (">=", [2, 3])])
def test_operators(spark, op, want):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b"), (3, 3.0, "c"), (None, None, None)], "i int, d double, s string")
    for column, value in (("i", 2), ("d", 2.0), ("s", "b")):
        kept = df.where(condition(F.col(column), df.schema[column].dataType, op, value))
        assert sorted(r["i"] for r in kept.collect()) == want


@pytest.mark.parametrize("op,want", [("=", 1), ("<>", 0), ("<", 0), ("<=", 1), (">", 0), (">=", 1)])
def test_tolerance(spark, op, want):
    df = spark.createDataFrame([(0.1 + 0.2,)], "d double")
    assert df.where(condition(F.col("d"), df.schema["d"].dataType, op, 0.3, Comparison(tolerance=1e-9))).count() == want


def test_truncation_and_text(spark):
    df = spark.createDataFrame([(1, "12abc"), (2, "x")], "i int, s string")
    assert df.where(condition(F.col("i"), df.schema["i"].dataType, "=", 2.5, Comparison(truncate=True))).count() == 1
    assert df.where(condition(F.col("i"), df.schema["i"].dataType, "=", 2.5)).count() == 0
    assert df.where(condition(F.col("i"), df.schema["i"].dataType, "<>", "abc")).count() == 0
    assert [r[0] for r in df.select(leading_number(F.col("s"))).collect()] == [12.0, None]


def test_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS x", "id * 3 AS y").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    text = plan(run(Select("t", ("x",), where=(Predicate("id", "=", 5),)), {"t": df}))
    assert "EqualTo(id,5)" in text and "ReadSchema: struct<id:bigint,x:bigint>" in text


# joins


@pytest.mark.parametrize("strategy,node", [("broadcast", "BroadcastHashJoin"), ("shuffle", "ShuffledHashJoin"), ("merge", "SortMergeJoin")])
def test_join_strategies(spark, strategy, node):
    a = spark.createDataFrame([(1, "p"), (2, "q"), (None, "n")], "x int, u string")
    b = spark.createDataFrame([(1, 5), (1, 6), (3, 7), (None, 8)], "y int, v int")
    df = inner_join(a, b, "x", "y", strategy)
    assert sorted((r["u"], r["v"]) for r in df.collect()) == [("p", 5), ("p", 6)]
    assert node in plan(df)


def test_broadcast_of_small_files_with_large_rows(spark, tmp_path):
    """Files of a few MB whose rows would fill the driver are dealt by key, or the other side is sent."""
    spark.range(0, 1_000_000, 1, 4).selectExpr("id AS x", "repeat('x', 600) AS u").write.parquet(str(tmp_path / "a"))
    spark.range(0, 100_000, 1, 4).selectExpr("id AS y", "sha2(cast(id AS string), 512) AS v").write.parquet(str(tmp_path / "b"))
    a, b = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b"))
    bound = broadcast_bound(spark)
    assert estimated_bytes(a) < min(estimated_bytes(b), bound) and hashed_bytes(b) < bound < hashed_bytes(a)
    both = inner_join(a, a.withColumnsRenamed({"x": "z", "u": "w"}), "x", "z", "broadcast")
    assert "BroadcastHashJoin" not in plan(both) and "SortMergeJoin" in plan(both)
    assert both.count() == 1_000_000
    for df, build in ((inner_join(a, b, "x", "y", "broadcast"), "BuildRight"), (inner_join(b, a, "y", "x", "broadcast"), "BuildLeft")):
        assert "BroadcastHashJoin" in plan(df) and build in plan(df)
        assert df.count() == 100_000
    few = inner_join(spark.createDataFrame([(7, "p"), (-1, "q")], "y long, v string"), a, "y", "x", "broadcast")
    assert "BuildLeft" in plan(few) and [r["v"] for r in few.collect()] == ["p"]


@pytest.mark.parametrize(
    "column,least",
    [("id", 16), ("CAST(NULL AS STRING)", 16), ("repeat('é', 500)", 1016), ("CAST(repeat('x', 500) AS BINARY)", 516), ("CAST(id AS DECIMAL(38, 2))", 32), ("array_repeat(id, 200)", 1600), ("array_repeat('', 200)", 1600), ("array_repeat(map(), 200)", 6400), ("array_repeat(struct('' AS a, '' AS b), 200)", 6400)],
)
def test_hashed_bytes(spark, column, least):
    df = spark.range(50).selectExpr("id AS `a.b`", f"{column} AS `c``d`")
    assert hashed_bytes(df) >= 50 * (least + 8)
    assert hashed_bytes(df.selectExpr("*", "`a.b`")) > hashed_bytes(df)
    assert hashed_bytes(df.where("false")) == 0


def test_join_names(spark):
    t = {"a": spark.createDataFrame([(1, 10)], "id int, v int"), "b": spark.createDataFrame([(1, 20)], "id int, v int")}
    assert run(Select("a", join=Join("b", "b.id", "a.id")), t).columns == ["a.id", "a.v", "b.id", "b.v"]
    assert run(Select("a", ("b.v",), Join("b", "id", "id")), t).collect() == [(20,)]
    for bad in (Select("a", ("v",), Join("b", "id", "id")), Select("a", None, Join("b", "id", "nope")), Select("a", ("zzz",))):
        with pytest.raises(SchemaError):
            run(bad, t)


# order, limit, aggregates


@pytest.fixture
def numbers(spark):
    return {"t": spark.createDataFrame([(i, i % 3, "" if i % 2 else "s") for i in (1, 2, 9, 10, 100)], "id int, v int, s string")}


def test_text_and_typed_order(numbers):
    get = lambda **o: [r[0] for r in run(Select("t", ("id",), order_by="id", limit=3), numbers, primary_keys={"t": "id"}, **o).collect()]
    assert get() == [1, 2, 9] and get(text_order=True) == [1, 10, 100]


def test_top_k_plan(numbers):
    assert "TakeOrderedAndProject" in plan(run(Select("t", ("id",), order_by="v", limit=2), numbers))


def test_limit_comes_before_aggregates(numbers):
    df = run(Select("t", (Aggregate("count"), Aggregate("sum", "id"), Aggregate("count", "s")), limit=3), numbers, primary_keys={"t": "id"})
    assert df.collect() == [(3, 111, 2)] and df.columns == ["count", "sum", "count_2"]


def test_aggregates_of_nothing_and_of_text(spark, numbers):
    empty = Select("t", (Aggregate("count"), Aggregate("sum", "id"), Aggregate("min", "v"), Aggregate("max", "v")), where=(Predicate("id", "<", 0),))
    assert run(empty, numbers).collect() == [(0, 0, 0, 0)]
    words = {"t": spark.createDataFrame([("1.5",), ("x",), ("2",)], "s string")}
    assert run(Select("t", (Aggregate("sum", "s"),)), words).collect() == [(3.5,)]
    with pytest.raises(ValueError):
        Aggregate("max")


def test_column_beside_aggregate(numbers):
    assert run(Select("t", ("id", Aggregate("count")), order_by="v", descending=True), numbers, primary_keys={"t": "id"}).collect() == [(2, 5)]
    assert run(Select("t", ("id", Aggregate("count"))), numbers, primary_keys={"t": "id"}).collect() == [(1, 5)]
    with pytest.raises(SchemaError):
        run(Select("t", ("id", Aggregate("count"))), numbers)


# versions


def test_snapshots(spark):
    base = spark.createDataFrame([("k", "a")], "k string, v string")
    row = lambda v, ts: versions(base.withColumn("v", F.lit(v)), "k", ts)
    log = row("v10", 10).unionByName(row("v20", 20)).unionByName(row("v30", 30)).unionByName(tombstones(base.select("k"), row("x", 1), "k", 40)).unionByName(row("v50", 50))
    seen = {ts: [r["v"] for r in snapshot(log, ts).collect()] for ts in (5, 25, 35, 45, 55)}
    assert seen == {5: [], 25: ["v20"], 35: ["v30"], 45: [], 55: ["v50"]}


def test_ranges(spark):
    df = spark.range(1, 121)
    assert [r[0] for r in key_range(df, "id", 9, 12).collect()] == [9, 10, 11]
    assert key_range(df, "id", 119).count() == 2
    assert sorted(r[0] for r in text_range(df, "id", "9", "92").collect()) == [9, 90, 91]
    assert text_range(df, "id", "99").count() == 1


# routing and figures


def test_shards(spark):
    keys = ["", "a", "42", "alice", "zr_a", "naïve", "x" * 300]
    for n in (1, 3, 8):
        got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(shard_of(F.col("k"), n)).collect()]
        assert got == [shard_of_key(k, n) for k in keys]
    # fixed values of FNV-1a
    assert shard_of_key("", 1 << 64) == 0xCBF29CE484222325 and shard_of_key("a", 1 << 64) == 0xAF63DC4C8601EC8C


def test_figures(spark):
    values = [5.0, 1.0, 1.0, 9.0, 3.0, 7.0, None]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    want = sorted(v for v in values if v is not None)
    row = exact_percentiles(df, "g", "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}).first()
    assert (row["p0"], row["p50"], row["p99"], row["p100"]) == (want[0], want[3], want[5], want[5])
    rng = random.Random(8)
    rows = [(g, float(rng.choice([rng.randrange(6), rng.gauss(0, 9)]))) for g, n in (("a", 1), ("b", 17), ("c", 3000)) for _ in range(n)] + [("only nulls", None), (None, 2.0)]
    shares = {f"q{i}": q for i, q in enumerate((0.0, 0.001, 0.25, 0.5, 0.95, 0.999, 1.0))}
    for accuracy in (10, 100, 10_000):
        got = {r["g"]: tuple(r[1:]) for r in exact_percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", shares, accuracy).collect()}
        for g in {x for x, v in rows if v is not None}:
            v = sorted(x for k, x in rows if k == g)
            assert got.pop(g) == tuple(v[min(len(v) - 1, int(q * len(v)))] for q in shares.values()), (g, accuracy)
        assert not got
    assert spark.range(1).select(unpadded_key(padded_key(F.lit(42)))).first() == (42,)
    assert spark.range(1).select(success_rate(F.lit(0), F.lit(0)), success_rate(F.lit(3), F.lit(1)), six_decimals(F.lit(1.5))).first() == (0.0, 75.0, "1.500000")


# store and transactions


def kv(store, rows=(("1", "a"), ("3", "c")), shards=1):
    store.create_table(TableDef("kv", (ColumnDef("k", ColumnType.VARCHAR), ColumnDef("v", ColumnType.VARCHAR)), "k", shards=shards))
    store.bulk_load("kv", store.spark.createDataFrame(list(rows), "k string, v string"))


def content(df):
    return {r["k"]: r["v"] for r in df.collect()}


@pytest.mark.parametrize("shards", [1, 3])
def test_own_writes_and_isolation(store, shards):
    kv(store, shards=shards)
    t, reader = Transaction.begin(store), Transaction.begin(store)
    t.insert("kv", {"k": "2", "v": "b"})
    t.update("kv", {"v": F.lit("z")}, key="1")
    t.delete("kv", key="3")
    assert content(t.scan("kv")) == {"1": "z", "2": "b"} and content(t.get("kv", "2")) == {"2": "b"} and content(t.get("kv", "3")) == {}
    ts = t.commit()
    assert content(reader.scan("kv")) == {"1": "a", "3": "c"}
    assert content(store.read("kv")) == {"1": "z", "2": "b"} and content(store.read("kv", as_of=ts - 1)) == {"1": "a", "3": "c"}
    store.compact("kv")
    assert content(store.read("kv")) == {"1": "z", "2": "b"}
    with pytest.raises(ValueError):
        store.read("kv", as_of=ts - 1)


def test_read_conflict_and_blind_write(store):
    kv(store)
    a, b, c = (Transaction.begin(store) for _ in range(3))
    a.get("kv", "1").collect()
    a.insert("kv", {"k": "9", "v": "x"})
    c.insert("kv", {"k": "1", "v": "blind"})
    b.update("kv", {"v": F.lit("new")}, key="1")
    b.commit()
    with pytest.raises(Conflict):
        a.commit()
    c.commit()
    assert content(store.read("kv")) == {"1": "blind", "3": "c"}


def test_write_skew_phantom_and_absent_read(store):
    kv(store, [("A", "10"), ("B", "10")])
    t1, t2 = Transaction.begin(store), Transaction.begin(store)
    t1.get("kv", "A"), t1.insert("kv", {"k": "B", "v": "1"})
    t2.get("kv", "B"), t2.insert("kv", {"k": "A", "v": "2"})
    t2.commit()
    with pytest.raises(Conflict):
        t1.commit()
    scans, absent, other = (Transaction.begin(store) for _ in range(3))
    assert scans.scan("kv").count() == 2 and absent.get("kv", "C").count() == 0
    for t in (scans, absent):
        t.insert("kv", {"k": "D", "v": "d"})
    other.insert("kv", {"k": "C", "v": "c"})
    other.commit()
    for t in (scans, absent):
        with pytest.raises(Conflict):
            t.commit()


def test_commit_spans_tables_and_survives_reopening(store, spark):
    kv(store)
    store.create_table(TableDef("w", (ColumnDef("id", ColumnType.INT), ColumnDef("n", ColumnType.BIGINT)), "id"))
    t = Transaction.begin(store)
    t.insert("w", {"id": 1, "n": 5})
    t.insert("kv", {"k": "7", "v": "q"})
    t.commit()
    again = Store(spark, store.root)
    assert content(again.read("kv"))["7"] == "q" and again.read("w").collect() == [(1, 5)]
    assert again.manifest().clock == store.manifest().clock


def test_unlisted_files_are_ignored_and_manifests_exclusive(store, spark):
    kv(store)
    table = store.manifest().catalog.get("kv")
    store.write_files(table, versions(spark.createDataFrame([("zz", "lost")], "k string, v string"), "k", 99))
    assert "zz" not in content(store.read("kv"))
    folder = Folder(spark, store.root)
    with pytest.raises(ManifestTaken):
        folder.add(folder.manifests()[-1], Manifest().to_json())


def test_other_types_pass_through(store, spark):
    rows = spark.sql("SELECT 1 AS k, TIMESTAMP_NTZ '2024-01-02 03:04:05' AS t, DATE '2024-01-02' AS d, array(1, 2) AS a, CAST(1.50 AS DECIMAL(9, 2)) AS m")
    store.create_table(TableDef.from_schema("w", rows.schema, "k"))
    store.bulk_load("w", rows)
    again = Store(spark, store.root)
    t = Transaction.begin(again)
    t.insert("w", {"k": 2, "t": "2025-01-01 00:00:00", "d": None, "a": [3], "m": 2})
    t.commit()
    assert again.read("w").schema.simpleString() == rows.schema.simpleString()
    assert [tuple(r)[0] for r in again.read("w").orderBy("k").collect()] == [1, 2] and again.read("w").where("t > '2024-12-31' AND a[0] = 3").count() == 1


def test_deltas_stay_few_and_snapshots_readable(store, monkeypatch):
    from marlstone.sources import store as stores

    kv(store)
    begin = Transaction.begin(store)
    begin.get("kv", "1").count()
    stamps = []
    for i in range(4):
        t = Transaction.begin(store)
        t.insert("kv", {"k": "n", "v": str(i)})
        stamps.append(t.commit())
    assert store.merge_deltas("kv", most=2) and len(store.manifest().files["kv"].deltas) == 1
    assert [content(store.read("kv", as_of=ts))["n"] for ts in stamps] == ["0", "1", "2", "3"] and "n" not in content(store.read("kv", as_of=stamps[0] - 1))
    begin.insert("kv", {"k": "1", "v": "mine"})
    begin.commit()  # key 1 has not changed, which the merged files still show
    assert not store.merge_deltas("kv", most=2)


def test_many_inserts_are_one_table(store):
    kv(store)
    t = Transaction.begin(store)
    for i in range(300):
        t.insert("kv", {"k": f"x{i % 200}", "v": str(i)})
    t.delete("kv", key="x5")
    t.insert("kv", {"k": "x5", "v": "last"})
    got = content(t.scan("kv"))
    assert len(got) == 202 and got["x5"] == "last" and got["x7"] == "207" and got["x150"] == "150"


def test_loads_refuse_bad_keys(store, spark):
    store.create_table(TableDef("w", (ColumnDef("id", ColumnType.INT),), "id"))
    for rows in ([(1,), (1,)], [(None,)]):
        with pytest.raises(ValueError):
            store.bulk_load("w", spark.createDataFrame(rows, "id int"))


def test_point_reads_prune_shards(store):
    kv(store, [(str(i), "v") for i in range(20)], shards=4)
    text = plan(Transaction.begin(store).get("kv", "7"))
    assert "PartitionFilters: [isnotnull(_shard" in text and "EqualTo(_pk,7)" in text


# sessions


def test_session_round_trip(session):
    tags = [r.tag for r in session.execute("CREATE TABLE test (id INT PRIMARY KEY, val VARCHAR); INSERT INTO test (id, val) VALUES (1, 'hello')")]
    assert tags == ["CREATE TABLE", "INSERT 0 1"]
    assert ids(session.execute("select * from TEST where id = 1")[0]) == [(1, "hello")]
    session.execute("BEGIN")
    session.execute("INSERT INTO test (id, val) VALUES (2, 'a')")
    assert session.status == "T" and session.execute("SELECT val FROM test WHERE id = 2")[0].tag == "SELECT 1"
    assert session.execute("SELECT * FROM test")[0].tag == "SELECT 2"
    session.execute("ROLLBACK")
    assert session.execute("SELECT * FROM test WHERE id = 2")[0].tag == "SELECT 0"
    assert session.execute("UPDATE test SET val = 'world' WHERE id = 1")[0].tag == "UPDATE 1"
    assert session.execute("UPDATE test SET val = 'x' WHERE id = 77")[0].tag == "UPDATE 0"
    assert ids(session.execute("SELECT val FROM test WHERE id = 1")[0]) == [("world",)]
    session.execute("INSERT INTO test (id, val) VALUES (1, 'again')")
    assert ids(session.execute("SELECT COUNT(*), COUNT(val) FROM test")[0]) == [(1, 1)]
    assert session.execute("DELETE FROM test WHERE id = 1")[0].tag == "DELETE 1"
    empty = session.execute("SELECT * FROM test")[0]
    assert empty.tag == "SELECT 0" and empty.schema.names == ["id", "val"]


def test_failed_transactions(session):
    session.execute("CREATE TABLE t (id INT PRIMARY KEY)")
    with pytest.raises(SessionError) as e:
        session.execute("SELEC 1")
    assert e.value.sqlstate == "42601" and session.status == "I"
    session.execute("BEGIN")
    with pytest.raises(SessionError):
        session.execute("SELECT nope FROM t")
    assert session.status == "E"
    for sql in ("SELECT * FROM t", "COMMIT"):
        with pytest.raises(SessionError) as e:
            session.execute(sql)
        assert e.value.sqlstate == "25P02"
    assert session.execute("ROLLBACK")[0].tag == "ROLLBACK" and session.status == "I"
    session.execute("BEGIN")
    with pytest.raises(SessionError):
        session.execute("BEGIN")
    assert session.status == "E"
    session.execute("ROLLBACK")
    for sql in ("COMMIT", "INSERT INTO t (id, x) VALUES (1, 2)", "SELECT * FROM missing", "UPDATE t SET id = 5 WHERE id = 1"):
        with pytest.raises(SessionError) as e:
            session.execute(sql)
        assert e.value.sqlstate == "XX000"


def test_tables_made_in_a_transaction(session):
    session.execute("BEGIN; CREATE TABLE t (id INT PRIMARY KEY); INSERT INTO t (id) VALUES (1)")
    other = Session(session.store)
    with pytest.raises(SessionError):
        other.execute("SELECT * FROM t")
    session.execute("ROLLBACK")
    with pytest.raises(SessionError):
        session.execute("SELECT * FROM t")
    session.execute("BEGIN; CREATE TABLE t (id INT PRIMARY KEY); INSERT INTO t (id) VALUES (2); COMMIT")
    assert ids(other.execute("SELECT * FROM t")[0]) == [(2,)]
    session.execute("BEGIN; CREATE TABLE u (id INT PRIMARY KEY)")
    other.execute("CREATE TABLE u (id INT PRIMARY KEY)")
    with pytest.raises(SessionError) as e:
        session.execute("COMMIT")
    assert e.value.sqlstate == "40001"


def test_large_results_are_refused(session):
    session.execute("CREATE TABLE t (id INT PRIMARY KEY); INSERT INTO t (id) VALUES (1); INSERT INTO t (id) VALUES (2)")
    session.most_rows = 1
    with pytest.raises(SessionError) as e:
        session.execute("SELECT * FROM t")
    assert e.value.sqlstate == "54000" and session.query("SELECT * FROM t").count() == 2
    assert session.execute("SELECT * FROM t LIMIT 1")[0].tag == "SELECT 1"


def test_updates_are_simultaneous(session):
    session.execute("CREATE TABLE t (id INT PRIMARY KEY, a INT, b INT); INSERT INTO t (id, a, b) VALUES (1, 10, 20)")
    session.execute("UPDATE t SET a = b + 1, b = a - 2 WHERE id = 1 AND a = 10")
    assert ids(session.execute("SELECT * FROM t")[0]) == [(1, 21, 8)]


def test_key_order_and_join(session):
    session.execute("CREATE TABLE a (id INT PRIMARY KEY, v FLOAT); CREATE TABLE b (id INT PRIMARY KEY, aid INT)")
    for i in (1, 2, 10):
        session.execute(f"INSERT INTO a (id, v) VALUES ({i}, {i}.25); INSERT INTO b (id, aid) VALUES ({i + 10}, {i})")
    assert ids(session.execute("SELECT id FROM a")[0]) == [(1,), (10,), (2,)]
    assert ids(session.execute("SELECT id FROM a WHERE id >= 2 ORDER BY id")[0]) == [(2,), (10,)]
    assert ids(session.execute("SELECT a.id, b.id FROM a JOIN b ON a.id = b.aid WHERE v < 5.0 ORDER BY b.id")[0]) == [(1, 11), (2, 12)]


def test_prepared(session):
    session.execute("CREATE TABLE t (id INT PRIMARY KEY, s VARCHAR)")
    session.prepare("put", "INSERT INTO t (id, s) VALUES ($1, $2)")
    for i, s in ((1, "7"), (2, "x'; DELETE FROM t")):
        session.bind("put", [i, s])
        session.execute_portal()
    session.prepare("get", "SELECT s FROM t WHERE id = $1 LIMIT $2")
    assert session.describe("get").names == ["s"] and session.describe("put") is None
    session.bind("get", [2, 1], "p")
    assert ids(session.execute_portal("p")) == [("x'; DELETE FROM t",)]
    for call, code in ((lambda: session.bind("nope", []), "26000"), (lambda: session.execute_portal("nope"), "34000"), (lambda: session.bind("get", []), "08P01")):
        with pytest.raises(SessionError) as e:
            call()
        assert e.value.sqlstate == code
    session.close("get")
    with pytest.raises(SessionError):
        session.bind("get", [1, 1])


# workload and histories


def test_generator(spark):
    got = {n: df.count() for n, df in order_entry(spark, Scale(1, 2, 3, 4)).items()}
    assert got == {"warehouse": 1, "district": 2, "customer": 6, "orders": 6, "order_line": 6, "stock": 4}
    tables = order_entry(spark, Scale())
    assert tables["orders"].agg(F.min("o_id"), F.max("o_id")).first() == (100000001, 209000100)
    assert tables["customer"].where("c_id = 230007").first() == (230007, 3, 2, "CUST-7", -10.0)
    assert tables["orders"].where("o_id = 203000007").first() == (203000007, 3, 2, 7, 0)


def test_workload(store):
    scale = Scale(1, 2, 3, 4)
    workload.load(store, scale)
    choice = workload.Choice(1, 1, 2, 3, 100.0)
    for kind in workload.RUNS:
        assert workload.run_one(store, kind, choice, scale)
    assert store.read("district").where("d_id = 11").first() == (11, 1, "DIST-1-1", 2, 30100.0)
    assert store.read("warehouse").first()["w_ytd"] == 300200.0
    assert store.read("customer").where("c_id = 110002").first()["c_balance"] == -109.0
    assert not workload.run_one(store, "order_status", workload.Choice(9, 0, 1, 1, 1.0), scale)
    assert workload.run_one(store, "delivery", workload.Choice(1, 0, 1, 1, 1.0, (3, 1)), scale)
    assert [store.read("customer").where(f"c_id = {k}").first()["c_balance"] for k in (100003, 110001, 100001)] == [-9.0, -9.0, -10.0]


def test_mix(store):
    scale = Scale(1, 2, 3, 4)
    workload.load(store, scale)
    report = workload.run_mix(store, 5, seed=3, scale=scale)
    figures = report.figures()
    assert sum(f["n"] for f in figures.values()) == 5 and set(figures) <= set(workload.MIX)
    assert all(f["p50"] <= f["p95"] <= f["p99"] and 0 <= f["success"] <= 100 for f in figures.values())
    drawn = workload.Choice.draw(random.Random(2), Scale())
    assert len(drawn.deliveries) == 10 and drawn.customer_key(4) == drawn.warehouse * 100000 + 40000 + drawn.deliveries[4]


def test_histories(spark):
    schema = "time_us long, process int, type string, f string, value array<string>"
    make = lambda *rows: spark.createDataFrame([(i, 0, *r) for i, r in enumerate(rows)], schema)
    pay = lambda a, b, n: ("ok", "transfer", [str(a), str(b), str(n)])
    assert check_bank(make(pay(0, 1, 5), pay(1, 2, 3)), 12, 1000) == (True, "a serial order exists", True)
    assert check_bank(make(pay(0, 1, 600), pay(0, 1, 600)), 12, 1000) == (False, "no serial order is free of overdrafts", True)
    assert check_bank(make(pay(0, 1, 1500), pay(2, 0, 600)), 12, 1000).ok  # in the other order
    assert not check_bank(make(pay(1, 1, 5)), 12, 1000).ok
    assert check_bank(make(*[pay(0, 1, 600)] * 11), 12, 1000) == (True, "money is conserved", False)
    # an account that was not declared brings money in, however many transfers there are
    for n in (2, 12):
        assert check_bank(make(*[pay(0, 99, 1)] * n), 5, 1000) == (False, "balances add up to 6000, not 5000", False)
    assert not check_bank(make(*[pay(0, "x", 1)] * 12), 5, 1000).ok and not check_bank(make(*[pay(0, "01", 1)] * 12), 5, 1000).ok
    r, w = (lambda v, k="0": ("ok", "read", [k, v])), (lambda v, k="0": ("ok", "write", [k, v]))
    assert check_registers(make(w("900"), r("900"))).ok and check_registers(make(r("1000"), w("900"), r("1000"))).ok
    assert not check_registers(make(r("1"), r("2"))).ok and check_registers(make(r("1"), r("2", "1"))).ok
    assert not check_registers(make(("ok", "read", ["0"]))).ok
    many = [w(str(i)) for i in range(6)] + [r(str(i)) for i in range(6)]
    assert check_registers(make(*many, r("start"))).ok and not check_registers(make(*many, r("start"), r("other"))).ok
    assert not check_history(make(("invoke", "read", ["0"])).where("false")).ok and check_history(make(*many, pay(0, 1, 5))).ok


def test_register_check_is_exact(spark):
    from itertools import permutations

    schema = "time_us long, process int, type string, f string, value array<string>"
    rng = random.Random(6)
    for _ in range(6):
        ops = [(rng.choice(["read", "write"]), rng.choice("ab"), rng.choice("12")) for _ in range(5)]
        found = False
        for order in permutations(ops):
            state, fits = {}, True
            for f, k, v in order:
                fits &= f == "write" or state.get(k, v) == v
                state[k] = v
            found |= fits
        rows = [(i, 0, "ok", f, [k, v]) for i, (f, k, v) in enumerate(ops)]
        assert check_registers(spark.createDataFrame(rows, schema)).ok == found, ops


def test_history_files(spark, tmp_path):
    from marlstone.operators.history import read_history

    (tmp_path / "h.jsonl").write_text('{"time_us": 1, "process": 0, "type": "ok", "f": "transfer", "value": ["0", "1", "600"]}\n' * 2)
    assert check_bank(read_history(spark, str(tmp_path / "h.jsonl")), 12, 1000) == (False, "no serial order is free of overdrafts", True)


def test_streamed_versions(spark, tmp_path):
    from marlstone.streaming import latest_changes, read_changes

    log = versions(spark.range(5).withColumn("v", F.lit("old")), "id", 1).unionByName(versions(spark.range(2).withColumn("v", F.lit("new")), "id", 2))
    log.write.parquet(str(tmp_path / "log"))
    job = latest_changes(read_changes(spark, str(tmp_path / "log"), log.schema)).writeStream.outputMode("complete").format("memory").queryName("newest").trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert sorted((r["id"], r["v"]) for r in spark.table("newest").collect()) == [(0, "new"), (1, "new"), (2, "old"), (3, "old"), (4, "old")]
