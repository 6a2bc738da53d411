"""Unsigned 64-bit arithmetic on signed BIGINT columns.

Spark's ANSI mode raises on BIGINT overflow, and the session setting is not ours to
change.  Additions and multiplications are therefore put together from 32- and 16-bit
limbs whose intermediate results stay below 2**63; shifts, AND, OR and XOR never raise.

The helpers return SQL expression text: one parse per step is much cheaper on the driver
than building the same tree from Column objects.  Operands are column names or literals; a
value that is used more than once is bound to a column of its own first (:class:`Chain`),
so that the optimizer keeps one copy of it instead of inlining the whole history into every
use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
_M32 = 0xFFFFFFFF
_M16 = 0xFFFF


def signed(value: int) -> int:
    """The BIGINT that carries the low 64 bits of ``value``."""
    value &= MASK64
    return value - (1 << 64) if value >> 63 else value


def long_lit(value: int) -> Column:
    return F.lit(signed(value)).cast("bigint")


def literal(value: int) -> str:
    return f"({signed(value)}L)"


def xor(a: str, b: str) -> str:
    return f"({a} ^ {b})"


def xor_shift(a: str, bits: int) -> str:
    return f"({a} ^ shiftrightunsigned({a}, {bits}))"


def rotate_left(a: str, bits: int) -> str:
    return f"(shiftleft({a}, {bits}) | shiftrightunsigned({a}, {64 - bits}))"


def _joined(high: str, low: str) -> str:
    return (
        f"(shiftleft({high} + shiftrightunsigned({low}, 32), 32) | ({low} & {_M32}))"
    )


def add(a: str, b: str) -> str:
    """``a + b`` modulo 2**64."""
    low = f"(({a} & {_M32}) + ({b} & {_M32}))"
    return _joined(f"shiftrightunsigned({a}, 32) + shiftrightunsigned({b}, 32)", low)


def add_const(a: str, constant: int) -> str:
    constant &= MASK64
    low = f"(({a} & {_M32}) + {constant & _M32}L)"
    return _joined(f"shiftrightunsigned({a}, 32) + {constant >> 32}L", low)


def mul_const(a: str, constant: int) -> str:
    """``a * constant`` modulo 2**64."""
    constant &= MASK64
    low, high = constant & _M32, constant >> 32
    # 16-bit limbs of a; limb products with 32-bit halves stay below 2**48.
    a0 = f"({a} & {_M16}L)"
    a1 = f"(shiftrightunsigned({a}, 16) & {_M16}L)"
    a2 = f"(shiftrightunsigned({a}, 32) & {_M16}L)"
    a3 = f"shiftrightunsigned({a}, 48)"
    first = f"({a0} * {low}L)"
    second = f"({a1} * {low}L + shiftrightunsigned({first}, 16))"
    upper = (
        f"(shiftrightunsigned({second}, 16) + {a0} * {high}L"
        f" + shiftleft({a1} * {high & _M16}L, 16)"
        f" + {a2} * {low}L + shiftleft({a3} * {low & _M16}L, 16))"
    )
    lower = f"(shiftleft({second} & {_M16}L, 16) | ({first} & {_M16}L))"
    return f"(shiftleft({upper}, 32) | {lower})"


class Chain:
    """Binds intermediate expressions to helper columns of a DataFrame."""

    def __init__(self, df: DataFrame, prefix: str):
        self.df = df
        self._prefix = f"__{prefix}_"
        self._names: list[str] = []

    def let(self, expression: str) -> str:
        """Bind an expression and return the name of its column."""
        name = f"{self._prefix}{len(self._names)}"
        self._names.append(name)
        self.df = self.df.selectExpr("*", f"{expression} AS `{name}`")
        return f"`{name}`"

    def finish(self, out: str, expression: str) -> DataFrame:
        """The frame with column ``out`` and without the helpers.

        The result passes through a one-element ``explode``: a later filter on ``out`` then
        stays above it.  Pushed down through the chain, it would be rewritten in terms of
        the input with every shared intermediate copied at every use, which grows
        exponentially.
        """
        kept = [c for c in self.df.columns if c not in set(self._names) and c != out]
        return self.df.select(*kept, F.explode(F.array(F.expr(expression))).alias(out))
