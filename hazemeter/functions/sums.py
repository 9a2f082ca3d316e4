"""Exact sums of readings, whatever their size.

A sum is added up from three whole numbers per reading, to the base of a billion: billions, ones, and billionths. Each
sum of those is exact in 64 bits for 2 ** 33 readings, and only when a group is done do they become one
number. So the order of readings does not matter, nothing drifts when a running sum takes readings back, and the work per
reading is integer arithmetic. Readings that no instrument gives (HUGE or more, infinite ones included) are kept
out of the sums and counted on their own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Readings of this size and more count as infinite.
HUGE = 10**15
BASE = 10**9
#: Type of a sum: nine decimals, and room for 10 ** 14 readings.
TOTAL = "DECIMAL(38,9)"
#: One group with a huge positive reading counts this much in ``i1`` and ``i2``, one with a huge negative reading counts one.
ABOVE = 1 << 31
#: What is carried of readings: billions, ones and billionths of the sums of P1 and P2, groups with huge ones of either, number.
SUMS = ("b1", "o1", "r1", "b2", "o2", "r2", "i1", "i2", "n")
DDL = ", ".join(f"{c} BIGINT" for c in SUMS)


def _parts(value: str) -> tuple[str, str, str]:
    """SQL aggregates: billions, ones and billionths of the sum of a DOUBLE or FLOAT expression, without huge readings."""
    usual = f"(case when abs({value}) < {HUGE}D then cast({value} as double) else 0D end)"
    whole = f"cast({usual} as bigint)"
    each = f"{whole} div {BASE}", f"{whole} % {BASE}", f"cast(rint(({usual} - cast({whole} as double)) * {BASE}D) as bigint)"
    return tuple(f"coalesce(sum({x}), 0L)" for x in each)


def _joined(billions: str, ones: str, rest: str) -> str:
    """SQL expression: the exact sum that three whole numbers stand for."""
    b, o, r = (f"cast({x} as decimal(19,0))" for x in (billions, ones, rest))
    return f"cast(cast({b} * {BASE}BD + {o} as decimal(28,0)) + cast({r} * 0.000000001BD as decimal(28,9)) as {TOTAL})"


def total(value: str) -> str:
    """SQL aggregate: the exact sum of a DOUBLE or FLOAT expression to nine decimals, without huge readings."""
    return _joined(*_parts(value))


def beyond(value: str) -> str:
    """SQL aggregate: whether a group has huge positive readings and whether it has huge negative ones, as one number."""
    some = lambda condition: f"cast(coalesce(max(case when {condition} then 1 else 0 end), 0) as bigint)"
    return f"({some(f'{value} >= {HUGE}D')} * {ABOVE}L + {some(f'{value} <= -{HUGE}D')})"


def sums(p1: str = "p1", p2: str = "p2") -> list[Column]:
    """SUMS of readings. Ones and billionths are left below a billion, so that sums of 2 ** 33 such rows are exact as well."""
    each = []
    for value in (p1, p2):
        b, o, r = _parts(value)
        o = f"({o} + {r} div {BASE})"
        each += [f"{b} + {o} div {BASE}", f"{o} % {BASE}", f"{r} % {BASE}"]
    each += [beyond(p1), beyond(p2), "count(1)"]
    return [F.expr(e).alias(c) for c, e in zip(SUMS, each)]


def added() -> list[Column]:
    """SUMS of rows that have them."""
    return [F.sum(c).alias(c) for c in SUMS]


def taken_back() -> list[Column]:
    """What adding to SUMS takes a row's own out again."""
    return [(-F.col(c)).alias(c) for c in SUMS]


def nothing() -> dict[str, Column]:
    """SUMS of no readings."""
    return {c: F.lit(0).cast("bigint") for c in SUMS}


def exact(side: int) -> Column:
    """The sum of P1 or P2 as one decimal number, from SUMS."""
    return F.expr(_joined(*(f"{c}{side}" for c in "bor")))


def nearest(side: int) -> str:
    """SQL expression: the sum of P1 or P2 as DOUBLE, from SUMS.

    Below nine millions all billionths together are a whole number that a DOUBLE holds, and one division rounds once.
    """
    b, o, r = (f"{c}{side}" for c in "bor")
    small = f"{b} = 0 and abs({o}) <= 9000000 and abs({r}) <= 1000 * {BASE}L"
    return f"(case when {small} then cast({o} * {BASE} + {r} as double) / {BASE}D else cast({_joined(b, o, r)} as double) end)"


def mean(total: str, beyond: str, n: str) -> str:
    """SQL expression: mean in single precision, divided in double and rounded once; NULL when empty.

    It is infinite where huge readings are among the group's, positive where any of them are.
    """
    usual = f"cast(cast({total} as double) / nullif(cast({n} as double), 0D) as float)"
    return f"case when {beyond} >= {ABOVE}L then float('Infinity') when {beyond} > 0 then float('-Infinity') else {usual} end"


def shown(total: str, beyond: str) -> Column:
    """A sum as DOUBLE, infinite where huge readings are in it."""
    return F.expr(f"case when {beyond} >= {ABOVE}L then double('Infinity') when {beyond} > 0 then double('-Infinity') else cast({total} as double) end")

