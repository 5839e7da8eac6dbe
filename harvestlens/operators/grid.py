"""Gridded climate: pivoting variables and extracting points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestlens.functions.columns import col, keyed, number, require_columns, within_box, within_dates
from harvestlens.operators.ordering import sorted_pieces
from harvestlens.session import partitions_for, store

METHODS = ("nearest", "previous", "next", "linear")


def pivot_variables(
    cells: DataFrame,
    keys: Sequence[str],
    variables: Sequence[str],
    variable_col: str = "variable",
    value_col: str = "value",
) -> DataFrame:
    """One column per variable; a coordinate with any variable stays (outer merge)."""
    rows = keyed(cells, keys).filter(col(variable_col).isin(list(variables)))
    return rows.groupBy(*keys).agg(
        *[F.avg(F.when(col(variable_col) == v, number(value_col))).alias(v) for v in variables]
    )


def climate_window(
    cells: DataFrame,
    lat_range: tuple | None = None,
    lon_range: tuple | None = None,
    date_range: tuple | None = None,
    variables: Sequence[str] | None = None,
) -> DataFrame:
    """Inclusive box and date filter, written so that it reaches the scan."""
    if lat_range and lon_range:
        cells = cells.filter(within_box(F.col("lat"), F.col("lon"), lat_range, lon_range))
    if date_range:
        cells = cells.filter(within_dates(F.col("date"), date_range))
    if variables is not None:
        cells = cells.filter(F.col("variable").isin(list(variables)))
    return cells


def grid_axes(cells: DataFrame) -> DataFrame:
    """``(axis, value)``: the distinct latitudes and longitudes of a grid.

    One scan of the two columns, combined on the map side. The values are written to the
    shared folder, so that later steps do not repeat the scan.
    """
    places = cells.select(number("lat").alias("lat"), number("lon").alias("lon"))
    found = places.unpivot([], ["lat", "lon"], "axis", "value").dropna().distinct()
    return store(found, "axes")


def axis_neighbours(points: DataFrame, point_col: str, axis: DataFrame, axis_col: str) -> DataFrame:
    """Add ``{axis}_below`` and ``{axis}_above``: the axis values around a coordinate.

    Both equal the coordinate on an exact hit and are NULL beyond the ends. Points without a
    coordinate drop out. The axis may be a few grid lines or millions of station coordinates,
    and the points may crowd anywhere: both are sorted together into pieces of about equal size.
    Inside a piece the neighbours are the last axis value before and the next one behind; beyond
    its edges they are carried over by running maxima and minima of the pieces' ends. Axis values
    may repeat. Large tables are cut into pieces of a bounded number of rows, so that a task's memory doesn't
    grow with them. Both tables are read several times, so they should come from storage.
    """
    x = number(point_col)
    below, above = f"{axis_col}_below", f"{axis_col}_above"
    values = axis.select(number(axis_col).alias("_x")).filter(F.col("_x").isNotNull())
    placed = points.withColumn("_x", x).filter(F.col("_x").isNotNull())
    both = placed.withColumn("_a", F.lit(None).cast("double")).unionByName(values.withColumn("_a", F.col("_x")), allowMissingColumns=True)
    # an axis value comes before the points at its place
    pieces = partitions_for(both.sparkSession, both.count())
    rows = sorted_pieces(both, [F.col("_x"), F.col("_a").isNull()], "axis-order", pieces)
    ends = rows.groupBy("_piece").agg(F.min("_a").alias("_lo"), F.max("_a").alias("_hi"))
    # every frame grows from its first row on: one that shrinks would be gone through again for each row
    upto = lambda w, n: w.rowsBetween(Window.unboundedPreceding, n)
    ends = ends.select(  # as many rows as pieces
        "_piece",
        F.max("_hi").over(upto(Window.orderBy("_piece"), -1)).alias("_earlier"),
        F.min("_lo").over(upto(Window.orderBy(F.col("_piece").desc()), -1)).alias("_later"),
    )
    if pieces:
        rows = rows.repartition(pieces, "_piece")
    inside = Window.partitionBy("_piece")
    last = F.last("_a", ignorenulls=True).over(upto(inside.orderBy("_at"), 0))
    following = F.last("_a", ignorenulls=True).over(upto(inside.orderBy(F.col("_at").desc()), 0))
    found = rows.withColumns({"_last": last, "_next": following}).filter(F.col("_a").isNull()).join(ends, "_piece")
    found = found.withColumn(below, F.coalesce("_last", "_earlier"))
    hit = F.when(F.col(below) == F.col("_x"), F.col("_x"))
    return found.withColumn(above, F.coalesce(hit, "_next", "_later")).select(
        *[F.col(f"`{c}`") for c in points.columns], below, above
    )


def _pick(axis_col: str, point_col: str, method: str):
    below, above, x = F.col(f"{axis_col}_below"), F.col(f"{axis_col}_above"), F.col(point_col)
    if method == "previous":
        return below
    if method == "next":
        return above
    return nearer(x, below, above)


def nearer(x: Column, below: Column, above: Column) -> Column:
    """The nearer of two neighbours; a tie goes to the larger coordinate."""
    return (
        F.when(above.isNull(), below)
        .when(below.isNull(), above)
        .when(above - x <= x - below, above)
        .otherwise(below)
    )


def locate_cells(
    points: DataFrame,
    axes: DataFrame,
    method: str = "nearest",
    lat_col: str = "lat",
    lon_col: str = "lon",
) -> DataFrame:
    """Cells of each point: ``cell_lat, cell_lon, weight``.

    ``axes`` comes from ``grid_axes``. One row per point, or up to four weighted corners for ``linear``. Points
    that have no such cell (beyond the ends, unless ``nearest``) drop out.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    require_columns(points, [lat_col, lon_col], "points")
    around = points.withColumnsRenamed({lat_col: "_plat", lon_col: "_plon"})
    for axis, p in (("lat", "_plat"), ("lon", "_plon")):
        line = axes.filter(F.col("axis") == axis).select(F.col("value").alias(axis))
        around = axis_neighbours(around, p, line, axis)
    helpers = ["lat_below", "lat_above", "lon_below", "lon_above"]
    if method != "linear":
        found = around.withColumns(
            {
                "cell_lat": _pick("lat", "_plat", method),
                "cell_lon": _pick("lon", "_plon", method),
                "weight": F.lit(1.0),
            }
        )
    else:
        def share(axis: str, p: str):
            width = F.col(f"{axis}_above") - F.col(f"{axis}_below")
            return F.when(width == 0, F.lit(0.0)).otherwise(
                F.try_divide(F.col(p) - F.col(f"{axis}_below"), width)
            )

        ty, tx = share("lat", "_plat"), share("lon", "_plon")
        corners = [
            F.struct(
                F.col(f"lat_{a}").alias("cell_lat"),
                F.col(f"lon_{b}").alias("cell_lon"),
                (wy * wx).alias("weight"),
            )
            for a, wy in (("below", 1 - ty), ("above", ty))
            for b, wx in (("below", 1 - tx), ("above", tx))
        ]
        found = around.withColumn("_c", F.explode(F.array(*corners))).select("*", "_c.*").drop("_c")
        found = found.filter(F.col("weight") > 0)
    return (
        found.filter(F.col("cell_lat").isNotNull() & F.col("cell_lon").isNotNull())
        .drop(*helpers)
        .withColumnsRenamed({"_plat": lat_col, "_plon": lon_col})
    )


def extract_points(
    points: DataFrame,
    cells: DataFrame,
    variables: Sequence[str],
    keys: Sequence[str] = ("date",),
    method: str = "nearest",
    id_col: str = "location_id",
    axes: DataFrame | None = None,
) -> DataFrame:
    """Series of every point from wide cells ``(lat, lon, keys..., variables...)``.

    ``linear`` renormalizes the corner weights over the values that are there.
    ``axes`` from an earlier ``grid_axes`` saves reading the cells for them.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    if axes is None:
        axes = grid_axes(cells)
    mapped = locate_cells(points.select(id_col, "lat", "lon"), axes, method)
    mapped = mapped.select(
        id_col, F.col("cell_lat").alias("lat"), F.col("cell_lon").alias("lon"), "weight"
    )
    joined = cells.join(mapped, ["lat", "lon"])
    if method != "linear":
        return joined.select(id_col, *keys, *variables)

    def blend(v: str):
        x = number(v)
        return F.try_divide(
            F.sum(F.col("weight") * x), F.sum(F.when(x.isNotNull(), F.col("weight")))
        ).alias(v)

    return joined.groupBy(id_col, *keys).agg(*[blend(v) for v in variables])
