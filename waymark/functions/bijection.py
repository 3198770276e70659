"""A keyed shuffle of row numbers that needs no sort: the place is computed.

Numbers below ``size`` lie on a grid of ``a`` by ``b`` cells that is hardly larger.
A Feistel network moves one coordinate by a keyed function of the other, round
after round, which can be undone and so is one to one. A number that leaves the
range goes through the network again until it is back; the grid has so few cells
beyond the range that this ends after at most ``SPARE + 1`` turns.
"""

from __future__ import annotations

import zlib
from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
#: Cells, at most, that the grid has beyond the range.
SPARE = 15
#: A prime below 2**31: cubes modulo it stay within 64 bits step by step.
PRIME = 2**31 - 1


def grid(size: int) -> tuple[int, int]:
    """The widest grid, at most square, with at most ``SPARE`` cells to spare."""
    if size < 1:
        return 1, 1
    a = isqrt(size)
    while -size % a > SPARE:
        a -= 1
    return a, -(-size // a)


def round_keys(seed: int, name: object) -> list[int]:
    """One key a round, from the checksum of the seed, the name and the round."""
    return [zlib.crc32(f"{seed}:{name}:{k}".encode()) % PRIME for k in range(ROUNDS)]


def _quotient(number: Column, divisor: int) -> Column:
    return F.call_function("div", number, F.lit(divisor).cast("long"))


def shuffled(number: Column, size: int, keys: list[int]) -> Column:
    """Where the row of this number goes: a permutation of 0 to ``size`` - 1."""
    a, b = grid(size)
    rounds = F.array(*[F.lit(key).cast("long") for key in keys])

    def mixed(value: Column, key: Column) -> Column:
        x = (value + key) % PRIME
        return x * x % PRIME * x % PRIME

    def turn(pair: Column, key: Column) -> Column:
        return F.struct(
            pair["v"].alias("u"),
            ((pair["u"] + mixed(pair["v"], key)) % pair["m"]).alias("v"),
            pair["n"].alias("m"),
            pair["m"].alias("n"),
        )

    def through(place: Column) -> Column:
        begin = F.struct(
            F.expr("0L").alias("u") if a == 1 else _quotient(place, b).alias("u"),
            (place % b).alias("v"),
            F.lit(a).cast("long").alias("m"),
            F.lit(b).cast("long").alias("n"),
        )
        return F.aggregate(rounds, begin, turn, lambda end: end["u"] * b + end["v"])

    turns = F.sequence(F.lit(0), F.lit(a * b - size))
    inside = F.lit(size).cast("long")
    return F.aggregate(
        turns,
        F.lit(-1).cast("long"),
        lambda place, k: F.when(k == 0, through(number))
        .when(place >= inside, through(place))
        .otherwise(place),
    )
