"""Keyed permutations of row numbers as column expressions.

Row ``i`` of ``n`` goes to place ``permuted(i, n, key)``: a balanced Feistel network over pairs
(i // side, i % side) with side * side >= n, and a walk along its cycle until the place is below
``n``. Any number of permutations needs no sort and no window: a shuffled column is one join.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4
WALK = 64
#: Factors of the round function; plain whole numbers, so that other engines can follow it.
ROW, KEY, TURN, PRIME, OUTER = 2_654_435_761, 40_503, 69_069, 2_147_483_647, 1_073_741_789


def _network(place: Column, side: int, key: Column) -> Column:
    start = F.struct(F.floor(place / F.lit(side)).cast("bigint").alias("l"), F.pmod(place, F.lit(side)).cast("bigint").alias("r"))

    def turn(at: Column, k: Column) -> Column:
        mixed = F.pmod(at["r"] * F.lit(ROW) + key * F.lit(KEY) + k * F.lit(TURN), F.lit(PRIME))
        mixed = F.pmod(mixed * mixed, F.lit(OUTER))
        return F.struct(at["r"].alias("l"), F.pmod(at["l"] + mixed, F.lit(side)).cast("bigint").alias("r"))

    end = F.aggregate(F.array(*[F.lit(k).cast("bigint") for k in range(1, ROUNDS + 1)]), start, turn)
    return end["l"] * F.lit(side) + end["r"]


def permuted(place: Column, n: int, key: Column) -> Column:
    """Place of row ``place`` (0 to n - 1) in the permutation of a whole-number ``key`` (0 to 2**31).

    The network covers at most 2 * sqrt(n) + 1 places beyond ``n``, so a walk is rare; one is at most that many steps
    long, and beyond ``WALK`` steps it ends with a probability under 1e-70 only for n above 900.
    """
    side = max(1, math.isqrt(max(n - 1, 0)) + 1)
    first = _network(place.cast("bigint"), side, key.cast("bigint"))
    again = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda at, _: F.when(at < n, at).otherwise(_network(at, side, key.cast("bigint"))))
    return F.when(first < n, first).otherwise(again)


def returned(place: np.ndarray, n: int, key: int) -> np.ndarray:
    """Rows that ``permuted`` sends to these places (0 to n - 1): its inverse, as arrays."""
    side = max(1, math.isqrt(max(n - 1, 0)) + 1)
    out = np.array(place, np.int64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = np.divmod(out[todo], side)
        for k in range(ROUNDS, 0, -1):
            mixed = (left * ROW + key * KEY + k * TURN) % PRIME
            left, right = (right - mixed * mixed % OUTER) % side, left
        out[todo] = left * side + right
        todo = todo[out[todo] >= n]
    return out
