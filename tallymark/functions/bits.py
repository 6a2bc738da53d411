"""Register index, rank and bitmap expressions over 64-bit hashes.

Layout used throughout: a hash is cut into its top ``k`` bits (``idx``) and the rest; the
rank ``rho`` is one plus the number of leading zeros of the rest.  LogLog and HyperLogLog
look only at the upper 32 bits, so their rank is the 64-bit rank capped at ``33 - k``.  One
register table therefore serves LogLog, HyperLogLog and HyperLogLog++, and the table at
precision 25 is the sparse HyperLogLog++ representation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPARSE_PRECISION = 25

# Ranks tested bit by bit before the general leading-zero count is used; a uniform hash
# leaves one row in 256 for the general case.
_QUICK_RANKS = 8


def _int(column: Column | int) -> Column:
    return column if isinstance(column, Column) else F.lit(column)


def shift_right(a: Column, bits: Column | int) -> Column:
    """Arithmetic right shift by a literal or a column."""
    return F.call_function("shiftright", a, _int(bits))


def shift_left(a: Column, bits: Column | int) -> Column:
    return F.call_function("shiftleft", a, _int(bits))


def bit_length(a: Column) -> Column:
    """Number of binary digits of a non-negative integer; 0 for 0."""
    return F.when(a == 0, F.lit(0)).otherwise(F.length(F.bin(a)))


def register_idx(h: Column, k: int) -> Column:
    return F.shiftrightunsigned(h, 64 - k).cast("int")


def register_rho(h: Column, k: int) -> Column:
    """Rank of the low ``64 - k`` bits of ``h``; ``65 - k`` when they are all zero."""
    chain = None
    for rank in range(1, _QUICK_RANKS + 1):
        hit = h.bitwiseAND(F.lit(1 << (64 - k - rank)).cast("bigint")) != 0
        chain = F.when(hit, rank) if chain is None else chain.when(hit, rank)
    rest = h.bitwiseAND(F.lit((1 << (64 - k - _QUICK_RANKS)) - 1).cast("bigint"))
    return chain.otherwise(F.lit(65 - k) - bit_length(rest)).cast("int")


def rho32(rho: Column, k: Column | int) -> Column:
    """Rank as seen by the 32-bit layouts."""
    return F.least(rho, F.lit(33) - _int(k))


def lowest_bit(x: Column) -> Column:
    """The lowest set bit of a non-negative integer, as a value; 0 for 0."""
    return x.bitwiseAND(-x)


def bitmap_bit(h: Column) -> Column:
    """The Probabilistic Counting bit (31-bit bitmap) that hash ``h`` sets, or 0."""
    x = F.shiftrightunsigned(h, 32).bitwiseAND(F.lit((1 << 31) - 1).cast("bigint"))
    return lowest_bit(x)


def trailing_ones(bitmap: Column, length: Column | int) -> Column:
    """Number of consecutive ones from bit 0, at most ``length``."""
    lowest_zero = F.bitwise_not(bitmap).bitwiseAND(bitmap + F.lit(1).cast("bigint"))
    return F.least(F.bit_count(lowest_zero - F.lit(1).cast("bigint")), _int(length))


def reduced_idx(idx: Column, k_from: Column | int, k_to: Column | int) -> Column:
    return shift_right(idx, _int(k_from) - _int(k_to))


def reduced_rho(idx: Column, rho: Column, k_from: Column | int, k_to: Column | int) -> Column:
    """Rank of a register after lowering the precision from ``k_from`` to ``k_to``.

    The index bits that are given up become leading bits of the remainder: if they are all
    zero the rank grows by their number, otherwise their own leading zeros decide.
    """
    drop = _int(k_from) - _int(k_to)
    suffix = idx.bitwiseAND(shift_left(F.lit(1), drop) - F.lit(1))
    return (
        F.when(drop == 0, rho)
        .when(suffix == 0, rho + drop)
        .otherwise(drop - bit_length(suffix) + 1)
        .cast("int")
    )


def sparse_code(h: Column) -> Column:
    """Index at the sparse precision."""
    return register_idx(h, SPARSE_PRECISION)


def sparse_entry(code: Column, rho: Column, k: Column | int) -> Column:
    """Normalised list entry ``code << 7 | payload`` used by the size rule.

    The payload carries the rank only where the bits of ``code`` below precision ``k`` are
    all zero, because otherwise the code itself determines it.
    """
    low = code.bitwiseAND(shift_left(F.lit(1), F.lit(SPARSE_PRECISION) - _int(k)) - F.lit(1))
    payload = F.when(low == 0, F.shiftleft(rho, 1).bitwiseOR(F.lit(1))).otherwise(0)
    return F.shiftleft(code.cast("bigint"), 7).bitwiseOR(payload.cast("bigint"))


def varint_bits(delta: Column) -> Column:
    """Bits of a base-128 variable-length integer."""
    digits = F.greatest(bit_length(delta), F.lit(1))
    return (F.ceil(digits / F.lit(7.0)) * 8).cast("bigint")
