"""Set predicates and set algebra on array columns; items are distinct and sorted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(items: Column) -> Column:
    """Sorted, without repeats and nulls."""
    return F.array_sort(F.array_distinct(F.array_compact(items)))


def is_subset(small: Column, large: Column) -> Column:
    return F.size(F.array_except(small, large)) == 0


def equal(a: Column, b: Column) -> Column:
    return canonical(a) == canonical(b)


def intersects(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def remove(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def negate(lits: Column) -> Column:
    return F.array_sort(F.transform(lits, lambda x: -x))


def unwrap_signed(item: Column) -> Column:
    """Literals that a 16-bit file holds as value + 65536."""
    return F.when(item > 32768, item - 65536).otherwise(item)


def code_length(count: Column, total: Column) -> Column:
    """Bits of a code that is used `count` of `total` times; 0 for an unused one."""
    return F.when(count > 0, -F.log2(count / total)).otherwise(F.lit(0.0))
