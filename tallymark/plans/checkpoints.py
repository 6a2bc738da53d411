"""Where along a stream an estimate is looked at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_BUDGET = 200


def checkpoint_plan(n: int, budget: int = DEFAULT_BUDGET) -> list[int]:
    """``budget`` positions in 1..n, always with 1 and n, denser at the start.

    The position of rank i is ``1 + i`` plus its part of the ``n - budget`` positions that are
    left out, so positions always rise.  That part grows with the fourth power of the rank over
    the first half of the ranks, which lie in the first tenth of the stream, and evenly over the
    second half.  A stream no longer than the budget has all its positions, a budget of one the last.
    """
    if n <= 0 or budget <= 0:
        return []
    if budget == 1:
        return [n]
    if n <= budget:
        return list(range(1, n + 1))
    return [1 + i + _left_out(n - budget, i, budget - 1) for i in range(budget)]


def _left_out(spare: int, i: int, last: int) -> int:
    """Positions passed over before rank ``i`` of 0..last, in whole numbers throughout."""
    if 2 * i <= last:
        return spare * (2 * i) ** 4 // (10 * last**4)
    return spare * (last + 9 * (2 * i - last)) // (10 * last)


def interval_of(position: Column, checkpoints: Sequence[int]) -> Column:
    """Index of the first checkpoint that is not before ``position``; NULL past the last.

    Written as a balanced decision tree, so a lookup costs eight comparisons in generated
    code rather than a scan of the whole list or a range join.
    """

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(position <= checkpoints[middle], tree(low, middle)).otherwise(
            tree(middle + 1, high)
        )

    last = len(checkpoints) - 1
    return F.when(position <= checkpoints[last], tree(0, last)).cast("int")


def checkpoint_at(index: Column, checkpoints: Sequence[int]) -> Column:
    """The checkpoint with a given index."""
    table = F.array(*[F.lit(c).cast("bigint") for c in checkpoints])
    return F.element_at(table, index + 1)
