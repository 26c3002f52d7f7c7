"""Checks of recorded histories: bank transfers and registers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = "time_us long, process int, type string, f string, value array<string>"
#: Orders of more transfers are not searched; conservation is checked for any number.
MOST_TRANSFERS = 10


class Verdict(NamedTuple):
    """``searched``: whether a serial order was looked for; without that, ``ok`` speaks of totals only."""

    ok: bool
    reason: str
    searched: bool


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).json(path)


def transfers(history: DataFrame) -> DataFrame:
    """Completed transfers: src, dst, amount."""
    done = history.where((F.col("f") == "transfer") & (F.col("type") == "ok") & (F.size("value") >= 3))
    return done.select(F.col("value")[0].alias("src"), F.col("value")[1].alias("dst"), F.col("value")[2].cast("long").alias("amount"))


def deltas(moves: DataFrame) -> DataFrame:
    """What each account gained: account, delta. Credits and debits are summed before they are dealt by account."""
    both = moves.select(F.explode(F.array(F.struct(F.col("src").alias("account"), (-F.col("amount")).alias("delta")), F.struct(F.col("dst").alias("account"), F.col("amount").alias("delta")))).alias("x"))
    return both.groupBy("x.account").agg(F.sum("x.delta").alias("delta"))


def self_transfers(moves: DataFrame) -> DataFrame:
    return moves.where(F.col("src") == F.col("dst"))


def bank_totals(moves: DataFrame, accounts: int, initial: int) -> DataFrame:
    """One row: ``total`` of all balances, ``expected``, and ``strangers``, touched accounts that are none of ``0 .. accounts - 1``.

    Every declared account starts with ``initial``, and so does every other account that
    a transfer touches; money on the latter makes the total exceed what is expected.
    """
    number = F.expr("try_cast(account as bigint)")
    declared = number.isNotNull() & (number >= 0) & (number < accounts) & (number.cast("string") == F.col("account"))
    gained = deltas(moves).agg(F.coalesce(F.sum("delta"), F.lit(0)).alias("gain"), F.count_if(~F.coalesce(declared, F.lit(False))).alias("strangers"))
    total = F.lit(accounts * initial).cast("long") + F.col("strangers") * F.lit(initial).cast("long") + F.col("gain")
    return gained.select(total.alias("total"), F.lit(accounts * initial).cast("long").alias("expected"), "strangers")


def replayable(moves: list[tuple[str, str, int]], initial: int) -> bool:
    """Whether some order of the transfers overdraws no account. Balances depend on the set of transfers done, not on their order."""
    reached = {0}
    for done in range(1 << len(moves)):
        if done not in reached:
            continue
        held: dict[str, int] = {}
        for i, (src, dst, amount) in enumerate(moves):
            if done >> i & 1:
                held[src] = held.get(src, initial) - amount
                held[dst] = held.get(dst, initial) + amount
        reached |= {done | 1 << i for i, (src, _, amount) in enumerate(moves) if not done >> i & 1 and held.get(src, initial) >= amount}
    return (1 << len(moves)) - 1 in reached


def check_bank(history: DataFrame, accounts: int, initial: int) -> Verdict:
    """Nobody pays oneself, balances add up to ``accounts * initial``, and few enough transfers can be replayed in an order without overdraft.

    A transfer to an account beyond the declared ones brings its initial balance in, so the total is too great.
    """
    moves = transfers(history)
    if self_transfers(moves).limit(1).count():
        return Verdict(False, "a transfer to oneself", False)
    few = moves.limit(MOST_TRANSFERS + 1).collect()
    sums = bank_totals(moves, accounts, initial).first()
    if sums["total"] != sums["expected"]:
        return Verdict(False, f"balances add up to {sums['total']}, not {sums['expected']}", False)
    if len(few) > MOST_TRANSFERS:
        return Verdict(True, "money is conserved", False)
    if replayable([tuple(m) for m in few], initial):
        return Verdict(True, "a serial order exists", True)
    return Verdict(False, "no serial order is free of overdrafts", True)


def register_ops(history: DataFrame) -> DataFrame:
    """Completed reads and writes: f, register, value; null where the record holds fewer than two strings."""
    done = history.where(F.col("f").isin("read", "write") & (F.col("type") == "ok"))
    whole = F.size("value") >= 2
    return done.select("f", F.when(whole, F.col("value")[0]).alias("register"), F.when(whole, F.col("value")[1]).alias("value"))


def register_faults(history: DataFrame) -> DataFrame:
    """Registers whose completed operations fit no serial order: ``register``, ``unwritten`` (values that were read and never written).

    A read sees the last value written, or, before any write, the one unknown initial
    value; reads of a written value can follow its write, so an order exists exactly
    when at most one value was read that nobody wrote. This holds for any number of
    operations. A record without a register or value is a fault under register null.
    """
    values = register_ops(history).groupBy("register", "value").agg(F.max((F.col("f") == "write").cast("int")).alias("written"), F.count_if(F.col("value").isNull()).alias("broken"))
    found = values.groupBy("register").agg(F.sum(1 - F.col("written")).alias("unwritten"), F.sum("broken").alias("broken"))
    return found.where("unwritten > 1 OR broken > 0").select("register", "unwritten")


def check_registers(history: DataFrame) -> Verdict:
    """Completed reads and writes fit some order in which a read sees the last value written or read; decided exactly for any number of operations."""
    if register_faults(history).limit(1).count():
        return Verdict(False, "no serial order fits", True)
    return Verdict(True, "a serial order exists", True)


def check_history(history: DataFrame, accounts: int = 12, initial: int = 1000) -> Verdict:
    """Both checks; an empty history is refused."""
    if not history.limit(1).count():
        return Verdict(False, "the history is empty", False)
    bank = check_bank(history, accounts, initial)
    return bank if not bank.ok else check_registers(history)._replace(searched=bank.searched)
