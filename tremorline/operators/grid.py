"""Padded spatial cells for work that is done cell by cell and kept from the home cell only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """``nx * ny`` cells over a rectangle, each widened by ``pad`` (in degrees) on all sides."""

    lon_min: float
    lat_min: float
    dx: float
    dy: float
    nx: int
    ny: int
    pad: float


def padded_cells(df: DataFrame, lat: str, lon: str, grid: Grid) -> DataFrame:
    """``df`` once for every cell whose padded box ``(low, high]`` holds the row, with ``i, j, is_home``.

    The cells are computed, not joined: a row knows the range of cells that reach it. Rows outside all padded
    boxes and rows without coordinates are left out; a row has at most one home cell.
    """
    def span(x, low, width, n):  # noqa: ANN001, ANN202
        first = F.greatest(F.ceil((x - low - grid.pad) / width) - 1, F.lit(0))
        last = F.least(F.ceil((x - low + grid.pad) / width) - 1, F.lit(n - 1))
        return F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))

    x, y = F.col(lon), F.col(lat)
    out = df.where(x.isNotNull() & y.isNotNull()).withColumn("i", F.explode(span(x, grid.lon_min, grid.dx, grid.nx)))
    out = out.withColumn("j", F.explode(span(y, grid.lat_min, grid.dy, grid.ny)))
    home = (F.ceil((x - grid.lon_min) / grid.dx) - 1 == F.col("i")) & (F.ceil((y - grid.lat_min) / grid.dy) - 1 == F.col("j"))
    return out.withColumn("is_home", home)
