"""Array helpers.

Catalyst inlines a computed column into a lambda that references it once,
and a lambda body runs once per element: ``transform(x, v -> v / sum_x)``
would re-evaluate ``sum_x`` for every element (O(n^2) per row). Scalars
are therefore handed to lambdas as a repeated array zipped with the input,
which is evaluated once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_with(arr: Column, scalar: Column, fn) -> Column:
    """``[fn(v, scalar) for v in arr]`` with ``scalar`` evaluated once."""
    return F.zip_with(arr, F.array_repeat(scalar, F.size(arr)), fn)


def explode_rows(df: DataFrame, keep: list, arr, *, pos: str = "pos", out: str = "value",
                 keep_pos: bool = True) -> DataFrame:
    """One row per array element: ``(*keep, pos, out)``.

    ``posexplode_outer`` plus a filter on the generated position. A plain
    explode makes Catalyst infer ``size(arr) > 0`` and push that filter below
    the projection that computes ``arr`` — re-running a costly array
    expression (tokeniser, softmax, sequence builder) a second time."""
    d = (df.select(*keep, F.posexplode_outer(arr).alias(pos, out))
         .where(F.col(pos).isNotNull()))
    return d if keep_pos else d.drop(pos)


def true_positions(mask: Column) -> Column:
    """0-based indices of the true entries of a boolean array."""
    return F.filter(F.transform(mask, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())
