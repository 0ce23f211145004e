"""Column expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(v: Column, width: int | None = None) -> Column:
    """Cells as doubles, null cells 0; with ``width``, longer arrays are cut and missing last cells are 0; null stays null."""
    cells = F.transform(v, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    if width is None:
        return cells
    return F.concat(F.slice(cells, 1, width), F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size(cells), F.lit(0))))


def dot(a: Column, b: Column) -> Column:
    """Sum of products, cell by cell; cells without a partner count 0."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """``v`` divided by its norm; all zeros if that is 0 or NaN, null stays null.

    The norm is bound once a row, as an element of an array; named in the inner lambda itself it would be worked out for
    every cell.
    """
    bound = F.array(F.struct(v.alias("v"), norm(v).alias("n")))
    scaled = F.transform(bound, lambda s: F.transform(s["v"], lambda x: F.when((s["n"] > 0) & ~F.isnan(s["n"]), x / s["n"]).otherwise(0.0)))
    return F.element_at(scaled, 1)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine; 1 if either norm is 0."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, 1 - dot(a, b) / lengths).otherwise(1.0)


def parsed(cells: Column, width: int | None = None) -> Column:
    """Texts as doubles, 0.0 where they are none; cut or padded to ``width`` if given."""
    numbers = F.transform(cells, lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))
    return filled(numbers, width)
