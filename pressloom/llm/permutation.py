"""Feistel permutations of 0 .. n-1 as native columns, and global row numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.llm.storage import checkpointed

ROUNDS = 4
LONGEST_WALK = 256


def keyed(key: str, step: Column, value: Column, digits: int = 8) -> Column:
    """A pseudorandom long of ``digits`` hexadecimal digits."""
    whole = F.md5(F.concat(F.lit(f"{key}:"), step.cast("string"), F.lit(":"), value.cast("string")).cast("binary"))
    return F.conv(F.substring(whole, 1, digits), 16, 10).cast("long")


def hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    """Both pads of HMAC-SHA256 under ``key``: who has one has the key."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def with_secret(rows: DataFrame, key: bytes, name: str) -> DataFrame:
    """``rows`` with the pads of ``key`` as a struct column.

    They come as one row of data that is broadcast, never as literals, so query
    plans, the user interface and event logs show the column's name only.
    """
    secret = rows.sparkSession.createDataFrame([hmac_pads(key)], "inner binary, outer binary")
    return rows.join(F.broadcast(secret.select(F.struct("inner", "outer").alias(name))))


def hmac_sha256(pads: Column, message: Column) -> Column:
    """HMAC-SHA256 of a string, from the pads of `with_secret`, as lower-case hexadecimal digits."""
    return F.sha2(F.concat(pads["outer"], F.unhex(F.sha2(F.concat(pads["inner"], message.cast("binary")), 256))), 256)


def secret_rounds(pads: Column, purpose: str, digits: int = 8) -> Callable[[Column, Column], Column]:
    """A round function that only who has the key can work out: ``digits`` hexadecimal digits of a keyed digest."""

    def draw(step: Column, value: Column) -> Column:
        message = F.concat(F.lit(f"{purpose}:"), step.cast("string"), F.lit(":"), value.cast("string"))
        return F.conv(F.substring(hmac_sha256(pads, message), 1, digits), 16, 10).cast("long")

    return draw


def digest_rounds(key: str) -> Callable[[Column, Column], Column]:
    """The round function of `keyed`; it spreads well, but hides nothing from who knows the key's text."""
    return lambda step, value: keyed(key, step, value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _half(n: int) -> int:
    root = isqrt(max(0, n - 1)) + 1 if n else 1
    return max(1, root)


def _once(x: Column, n: int, draw: Callable[[Column, Column], Column]) -> Column:
    half = _half(n)
    start = F.struct(F.floor(x / half).alias("l"), F.pmod(x, F.lit(half).cast("long")).alias("r"))
    rounds = F.array(*[F.lit(i) for i in range(1, ROUNDS + 1)])
    step = lambda s, i: F.struct(s["r"].alias("l"), F.pmod(s["l"] + draw(i, s["r"]), F.lit(half).cast("long")).alias("r"))
    return F.aggregate(rounds, start, step, lambda s: s["l"] * half + s["r"])


def permuted(value: Column, n: int, key: str | Callable[[Column, Column], Column]) -> Column:
    """The place of ``value`` in a permutation of 0 .. n-1 under a key, or a round function of step and half.

    A Feistel network over the square of ``half`` >= sqrt(n) numbers permutes a
    domain that is larger by 2*sqrt(n) at most; values that leave 0 .. n-1 walk
    along their cycle until they are back. Null gives null.
    """
    half = _half(n)
    return permuted_among(value, half * half, key, lambda x: x < n, half * half - n + 1)


def permuted_among(value: Column, square: int, key: str | Callable[[Column, Column], Column], accept: Callable[[Column], Column], longest: int = LONGEST_WALK) -> Column:
    """A keyed permutation of the numbers below ``square`` that ``accept`` accepts, by walking on from others."""
    draw = digest_rounds(key) if isinstance(key, str) else key
    steps = F.sequence(F.lit(1), F.lit(min(LONGEST_WALK, longest)))

    def back(first: Column) -> Column:
        walk = F.aggregate(steps, first, lambda x, _: F.when(accept(x), x).otherwise(_once(x, square, draw)))
        return F.when(accept(first), first).otherwise(walk)

    def checked(place: Column) -> Column:
        return F.when(accept(place), place).when(place.isNotNull(), F.raise_error(F.lit("the cycle is longer than the walk")).cast("long"))

    return let(let(_once(value, square, draw), back), checked)


def numbered(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """``row, number``: structs of all columns with global numbers from 0 in ``order``; and how many there are.

    Rows are range partitioned and sorted once and then kept in the shared
    folder, so that the numbers, counted per partition and shifted by the rows
    before, stay the same in every later read. The offsets are one small row for each
    partition. Ties go by scan order; give an order that tells unequal rows apart.
    """
    keys = [f"o{i}" for i in range(len(order))]
    packed = rows.select(F.struct("*").alias("row"), *[o.alias(k) for o, k in zip(order, keys, strict=True)], F.monotonically_increasing_id().alias("tie"))
    ranged = checkpointed(packed.repartitionByRange(*keys, "tie").sortWithinPartitions(*keys, "tie").select("row"))
    place = F.monotonically_increasing_id()
    placed = ranged.withColumn("part", F.shiftright(place, 33)).withColumn("within", place.bitwiseAND(F.lit((1 << 33) - 1)))
    counts = sorted((r[0], r[1]) for r in placed.groupBy("part").count().collect())
    offsets, total = [], 0
    for part, count in counts:
        offsets.append((part, total))
        total += count
    table = rows.sparkSession.createDataFrame(offsets, "part long, offset long")
    return placed.join(F.broadcast(table), "part").select("row", (F.col("offset") + F.col("within")).alias("number")), total
