"""Reproducible random tokens as column expressions.

The generator's state after n draws is seed + n * step modulo 2 ** 32, so that any draw of any row is a closed form of its
number: no state is carried, rows need no order, and a retried task makes the same tokens. Numbers are 32-bit, held in longs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MASK))


def _shift(x: Column, n: int) -> Column:
    return F.shiftrightunsigned(x, n)


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, by halves, so that no long overflows."""
    return _low(a * b.bitwiseAND(F.lit(0xFFFF)) + F.shiftleft((a * _shift(b, 16)).bitwiseAND(F.lit(0xFFFF)), 16))


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it reads it."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def draw(seed: Column, n: Column | int) -> Column:
    """The ``n``-th number (from 1) of mulberry32 with this seed: a whole number from 0 to 2 ** 32 - 1."""
    step = F.lit(0x6D2B79F5).cast("long")
    n = n if isinstance(n, Column) else F.lit(n)
    state = _low(_low(seed.cast("long")) + _times(step, _low(n.cast("long"))))
    first = lambda s: _times(s.bitwiseXOR(_shift(s, 15)), s.bitwiseOR(F.lit(1)))
    second = lambda x: x.bitwiseXOR(_low(x + _times(x.bitwiseXOR(_shift(x, 7)), x.bitwiseOR(F.lit(61)))))
    last = lambda x: _low(x.bitwiseXOR(_shift(x, 14)))
    return _let(_let(_let(state, first), second), last)


def below(seed: Column, n: Column | int, count: Column | int) -> Column:
    """The ``n``-th draw as a whole number from 0 to ``count`` - 1."""
    count = count if isinstance(count, Column) else F.lit(count)
    return _shift(draw(seed, n) * count.cast("long"), 32)


def soup(seed: Column, tokens: list[str], least: int = 2, most: int = 40) -> Column:
    """``least`` to ``most`` tokens, run together: the first draw says how many, each further one which."""
    size = F.lit(least) + below(seed, 1, most - least + 1)
    those = F.array(*map(F.lit, tokens))
    return F.array_join(F.transform(F.sequence(F.lit(2).cast("long"), size + 1), lambda k: F.get(those, below(seed, k, len(tokens)).cast("int"))), "")
