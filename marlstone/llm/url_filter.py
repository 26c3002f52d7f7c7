"""URL rules answered by a Bloom filter cascade, in DataFrame functions only.

A cascade holds a set of listed keys exactly with respect to a known universe:
level 1 encodes the listed keys, level 2 the universe keys that level 1 wrongly
accepts, level 3 the listed keys that level 2 wrongly accepts, and so on until a
level accepts nothing wrongly. A key of the universe is then listed exactly when
the first level that refuses it has an even number, or when an odd number of
levels all accept it. Lookups are expressions over literals: no join is planned.

Each url offers the keys (host suffix, path prefix) that a rule could name. The
universe is the full set of these keys in the corpus, so membership is exact.

Edge cases: a null url, or one without ``://``, has empty host and path and can
match only a rule for the empty host (there is none), so it gets the default
verdict. Rows are kept one for one, repeated rows included; other columns pass
through, and a column named like an output column is replaced by the output.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import discard, renamed, settle

URL_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A level stores 7 bits a byte, so that each byte is ASCII and ``ascii`` can read it; 8 bytes make a cell.
BITS_A_BYTE, BITS_A_CELL = 7, 56
#: Levels travel inside the plan to every task, so they are no larger than this; longer lists are joined instead.
MAX_LEVEL_BYTES = 64 << 20


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL_PATTERN, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PATTERN, 2), F.lit(""))


@dataclass(frozen=True)
class Level:
    seed: int
    bits: int
    probes: int
    data: bytes

    def accepts(self, key: Column) -> Column:
        data = F.lit(self.data)
        held = F.lit(True)
        for position in positions(key, self.seed, self.bits, self.probes):
            byte = F.ascii(data.substr((position / BITS_A_BYTE).cast("int") + 1, F.lit(1)).cast("string"))
            held = held & (F.call_function("shiftright", byte, (position % BITS_A_BYTE).cast("int")).bitwiseAND(1) == 1)
        return held


def positions(key: Column, seed: int, bits: int, probes: int) -> list[Column]:
    first, step = F.xxhash64(key, F.lit(seed)), F.xxhash64(F.lit(seed), key)
    return [F.pmod(F.shiftright(first, 1) + F.lit(i) * F.shiftright(step, 8), F.lit(bits)) for i in range(probes)]


def level_bits(count: int, bits_a_key: int) -> int:
    return max(BITS_A_CELL, -(-count * bits_a_key // BITS_A_CELL) * BITS_A_CELL)


def encode(keys: DataFrame, key: str, count: int, seed: int, bits_a_key: int, probes: int) -> Level:
    """Set the bits of all ``keys``: an aggregate by cell, whose size is bounded by the level's own."""
    bits = level_bits(count, bits_a_key)
    at = F.explode(F.array(*positions(F.col(key), seed, bits, probes)))
    cells = (
        keys.select(at.alias("at"))
        .groupBy((F.col("at") / BITS_A_CELL).cast("long").alias("cell"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % BITS_A_CELL).cast("int"))).alias("bits"))
    )
    data = bytearray(bits // BITS_A_BYTE)
    for cell, held in cells.toLocalIterator():
        for i in range(8):
            data[8 * cell + i] = held >> (BITS_A_BYTE * i) & 127
    return Level(seed, bits, probes, bytes(data))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built over."""
        member = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels), 0, -1):
            member = F.when(self.levels[number - 1].accepts(key), member).otherwise(F.lit(number % 2 == 0))
        return member


def build_cascade(listed: DataFrame, universe: DataFrame, key: str = "key", *, bits_a_key: int = 12, probes: int = 4, most_bytes: int | None = None) -> Cascade | None:
    """``listed`` and ``universe`` have a string column ``key``. The universe may repeat keys and hold listed ones.

    None if a level would be larger than ``most_bytes`` (default: ``MAX_LEVEL_BYTES``).
    What a level wrongly accepts is written for the next, and gone when the cascade is built.
    """
    most_bytes = MAX_LEVEL_BYTES if most_bytes is None else most_bytes
    listed = settle(listed.select(key).where(F.col(key).isNotNull()).distinct(), "listed-keys")
    inside, outside, levels, written = listed, None, [], [listed]
    while True:
        count = inside.count()
        if not count:
            break
        if level_bits(count, bits_a_key) // BITS_A_BYTE > most_bytes:
            levels = None
            break
        levels.append(encode(inside, key, count, len(levels) + 1, bits_a_key, probes))
        level = levels[-1]
        if outside is None:  # the only pass over the whole universe: filtered first, made distinct after
            wrong = universe.select(key).where(level.accepts(F.col(key))).distinct().join(listed, key, "left_anti")
        else:
            wrong = outside.where(level.accepts(F.col(key)))
        wrong = settle(wrong, "wrong-keys")
        written.append(wrong)
        inside, outside = wrong, inside
    discard(*written)
    return None if levels is None else Cascade(tuple(levels))


def mark_listed(df: DataFrame, key: Column, listed: DataFrame, *, listed_key: str = "key", flag: str = "is_listed", most_bytes: int | None = None) -> DataFrame:
    """``df`` with the boolean column ``flag``: whether ``key`` is among ``listed``. Null keys are not.

    Lists of any length: as many keys as levels of ``most_bytes`` hold (some 39 million by
    default) are looked up in a cascade over the table's own keys, longer lists are joined.
    """
    _, names = renamed(df)
    keyed = df.select(*[F.col(f"`{c}`").alias(names[c]) for c in df.columns], key.cast("string").alias("_key"))
    keys = listed.select(F.col(f"`{listed_key}`").cast("string").alias("key"))
    cascade = build_cascade(keys, keyed.select(F.col("_key").alias("key")).where("_key IS NOT NULL"), most_bytes=most_bytes)
    if cascade is not None:
        marked = keyed.withColumn("_flag", F.coalesce(cascade.contains(F.col("_key")), F.lit(False)))
    else:
        once = keys.where("key IS NOT NULL").distinct().withColumn("_there", F.lit(True))
        marked = keyed.join(once, keyed["_key"] == once["key"], "left").withColumn("_flag", F.coalesce("_there", F.lit(False)))
    return marked.select(*[F.col(names[c]).alias(c) for c in df.columns if c != flag], F.col("_flag").alias(flag))


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def candidate_keys(host: Column, path: Column, rules: list[Rule]) -> Column:
    """All keys that could name a rule: host suffixes up to the deepest rule host, path prefixes of the rules' lengths.

    The number of keys a row gets depends on the rules alone, however long its url is.
    """
    depth = max(r.host.count(".") + 1 for r in rules)
    suffixes = F.array(*[F.substring_index(host, ".", -i) for i in range(1, depth + 1)])
    prefixes = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted({len(r.path) for r in rules})]
    keys = F.array(*[joined(suffixes, prefix) for prefix in prefixes])
    return F.array_compact(F.array_distinct(F.flatten(keys)))


def joined(suffixes: Column, prefix: Column) -> Column:
    return F.transform(suffixes, lambda s: F.concat(s, prefix))


def apply_rules(df: DataFrame, rules: list[Rule], *, url: str = "url", default: str = "allow", listed: str = "block") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's; the
    longest fitting rule decides. One cascade says which keys of the corpus are
    rules, a second which of the rules have the verdict ``listed``. A url that no
    rule fits is not on the list and gets ``default``.
    """
    out = df.withColumns({"host": url_host(F.col(f"`{url}`")), "path": url_path(F.col(f"`{url}`"))})
    if not rules:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    spark = df.sparkSession
    bare = df.select(url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    universe = bare.select(candidate_keys(F.col("host"), F.col("path"), rules).alias("keys"))
    named = key_table(spark, [r.key for r in rules])
    # the driver holds the rules as a list, and a filter is smaller than its list
    is_rule = build_cascade(named, universe.select(F.explode("keys").alias("key")), most_bytes=sys.maxsize)
    is_listed = build_cascade(key_table(spark, [r.key for r in rules if r.verdict == listed]), named, most_bytes=sys.maxsize)
    other = next((r.verdict for r in rules if r.verdict != listed), default)
    fitting = F.filter(candidate_keys(F.col("host"), F.col("path"), rules), is_rule.contains)
    longest = F.array_max(F.transform(fitting, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    out = out.withColumn("rule", longest)
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(is_listed.contains(F.col("rule")), F.lit(listed)).otherwise(F.lit(other))
    return out.withColumn("verdict", verdict)


def key_table(spark, keys: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.lit(keys) if keys else F.array().cast("array<string>")).alias("key"))
