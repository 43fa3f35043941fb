"""A 64-bit spatial cell: a 24-bit grid walked by a Hilbert curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bits of each coordinate that one step of the walk takes.
STEP = 3


def _steps() -> list[int]:
    """For each state and STEP bits of x and of y: the curve's digits, times 4, plus the state after them. A state says whether
    the coordinates are swapped (1) and inverted (2) by the quadrants so far."""
    out = []
    for state in range(4):
        for x in range(1 << STEP):
            for y in range(1 << STEP):
                now, digits = state, 0
                for k in range(STEP - 1, -1, -1):
                    a, b = (x >> k) & 1, (y >> k) & 1
                    if now & 1:
                        a, b = b, a
                    a, b = a ^ (now >> 1), b ^ (now >> 1)
                    digits = digits * 4 + ((3 * a) ^ b)
                    now ^= 0 if b else 1 + 2 * a
                out.append(digits * 4 + now)
    return out


def hilbert(x: Column, y: Column, order: int = 24) -> Column:
    """The position of grid point (x, y) along the curve; both are clamped to the grid by the caller."""
    table = F.from_json(F.lit(str(_steps())), "array<int>")
    steps = -(-order // STEP)
    # Leading zero bits swap the coordinates once each, so the walk starts swapped if there is an odd number of them.
    start = F.struct(F.lit(0).cast("bigint").alias("d"), F.lit((steps * STEP - order) % 2).alias("state"))
    bits = lambda v, k: F.call_function("shiftright", v.cast("bigint"), k).bitwiseAND(F.lit((1 << STEP) - 1)).cast("int")

    def step(s, k):
        found = F.get(table, s["state"] * (1 << 2 * STEP) + bits(x, k) * (1 << STEP) + bits(y, k))
        return F.struct((s["d"] * (1 << 2 * STEP) + F.floor(found / 4)).cast("bigint").alias("d"), (found % 4).cast("int").alias("state"))

    return F.aggregate(F.sequence(F.lit((steps - 1) * STEP), F.lit(0), F.lit(-STEP)), start, step, lambda s: s["d"])


def grid(lat: Column, lng: Column) -> tuple[Column, Column]:
    most = (1 << 24) - 1
    at = lambda v, half: F.least(F.greatest(F.floor((v + half) / (2 * half) * most), F.lit(0)), F.lit(most)).cast("bigint")
    return at(lng, 180.0), at(lat, 90.0)


def cell64(position: Column, resolution: int) -> Column:
    """The 64-bit cell id of a curve position; not Uber's H3, whose libraries give other ids."""
    res = max(0, min(15, resolution))
    part = lambda n: F.call_function("shiftright", position, F.lit(n))
    head = (1 << 59) | (res << 52)
    base = F.call_function("shiftleft", part(45).bitwiseAND(F.lit(0x7F)), F.lit(45))
    return base.bitwiseOR(part(15 - res).bitwiseAND(F.lit((1 << 45) - 1))).bitwiseOR(F.lit(head))


def cells(df: DataFrame, lat: str, lng: str, resolution: int, position: str = "hilbert", into: str = "cell") -> DataFrame:
    """df with the curve position of each place, walked once, and its cell."""
    out = df.withColumn(position, hilbert(*grid(F.col(lat), F.col(lng))))
    return out.withColumn(into, cell64(F.col(position), resolution))
