"""Left joins in which missing keys match, and lookups sized before broadcast."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tenurelens.sources.workspace import Lookup

BROADCAST_ROWS = 250_000
BROADCAST_BYTES = 64 << 20

Key = str | tuple[str, str]

# never null by the input contract, so a plain equality is enough
NOT_NULL_KEYS = {"EMPLOYEE_ID", "PAYROLL_SEQUENCE", "MAX_PP"}


def _pairs(on: Sequence[Key]) -> list[tuple[str, str]]:
    return [(k, k) if isinstance(k, str) else k for k in on]


def _same(left: Column, right: Column, key: str) -> Column:
    return left == right if key in NOT_NULL_KEYS else left.eqNullSafe(right)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[Key], how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys match; only the left copy of a key is kept.

    ``on`` holds names, or (left name, right name) where they differ.
    """
    pairs = _pairs(on)
    renamed = right.withColumnsRenamed({r: f"__key_{r}" for _, r in pairs})
    cond = reduce(
        lambda a, b: a & b,
        [_same(F.col(l), F.col(f"__key_{r}"), l) for l, r in pairs],
    )
    joined = left.join(renamed, cond, how)
    return joined.drop(*[f"__key_{r}" for _, r in pairs])


def lookup_join(left: DataFrame, lookup: Lookup, on: Sequence[Key]) -> DataFrame:
    """Left join to a lookup whose row count was measured.

    Up to ``BROADCAST_ROWS`` rows and ``BROADCAST_BYTES`` bytes the lookup is broadcast and
    ``left`` does not move. Beyond that it is a plain left join, in which AQE splits
    the left rows of a hot key over several tasks.
    """
    small = lookup.rows <= BROADCAST_ROWS and lookup.bytes <= BROADCAST_BYTES
    return null_safe_join(left, F.broadcast(lookup.frame) if small else lookup.frame, on)
