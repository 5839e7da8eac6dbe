"""Points in polygons given as edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestlens.functions.columns import col
from harvestlens.session import store

_EDGE = ("x1", "y1", "x2", "y2")


def _crossings(x1: Column, y1: Column, x2: Column, y2: Column, x0: Column, y0: Column, px: Column, py: Column) -> Column:
    """How often an edge is crossed on the way from (x0, y0) up to (x0, py) and on to (px, py); py >= y0, px >= x0."""
    beside = (x1 > x0) != (x2 > x0)
    at_y = y1 + F.try_divide((x0 - x1) * (y2 - y1), x2 - x1)
    straddles = (y1 > py) != (y2 > py)
    at_x = x1 + F.try_divide((py - y1) * (x2 - x1), y2 - y1)
    up = F.when(beside & (at_y > y0) & (at_y <= py), 1).otherwise(0)
    along = F.when(straddles & (at_x > x0) & (at_x <= px), 1).otherwise(0)
    return up + along


def _meets_cell(x0: Column, y0: Column, size: Column) -> Column:
    """The edge may touch the cell: boxes overlap, and the cell's corners aren't all on one side of its line."""
    x1, y1, x2, y2 = (F.col(c) for c in _EDGE)
    overlap = (
        (F.least(x1, x2) <= x0 + size) & (F.greatest(x1, x2) >= x0) & (F.least(y1, y2) <= y0 + size) & (F.greatest(y1, y2) >= y0)
    )
    sides = [(x2 - x1) * (cy - y1) - (y2 - y1) * (cx - x1) for cx in (x0, x0 + size) for cy in (y0, y0 + size)]
    scale = (F.abs(x2 - x1) + F.abs(y2 - y1)) * size * 1e-9
    return overlap & (F.least(*sides) <= scale) & (F.greatest(*sides) >= -scale)


def polygon_index(
    edges: DataFrame, polygon_id: str = "polygon_id", tile: float = 1.0, most: int = 256, depth: int = 16
) -> DataFrame:
    """Leaf cells of a quadtree with the polygons that meet them, stored.

    ``_level, _cx, _cy, polygon, _odd, _edges``: the cell, whether its lower left corner lies in the
    polygon, and the polygon's edges that touch the cell (none: the cell lies inside as a whole).

    Cells of one ``tile`` are made first; a cell that more than ``most`` edges touch is cut into
    four, ``depth`` times at most, so that only a place where very many edges meet can stay
    crowded. Edges stay rows until the leaves, a corner's parity follows from that of its parent
    and the parent's edges, and only crowded cells are worked on again.

    The joins are by sorting: a stored table of a few MB holds many times that in rows, and a broadcast would
    bring it to the driver on every level.
    """
    e = edges.select(col(polygon_id).alias("_p"), *[col(c).cast("double").alias(c) for c in _EDGE])
    e = store(e.dropna(), "polygon-edges")
    cell = lambda c: F.floor(c / tile)
    x0, y0 = F.col("_cx") * tile, F.col("_cy") * tile
    # level 0: the edges by tile, and the parity of the corners of all tiles of a polygon's box
    pieces = (
        e.withColumn("_cx", F.explode(F.sequence(cell(F.least("x1", "x2")), cell(F.greatest("x1", "x2")))))
        .withColumn("_cy", F.explode(F.sequence(cell(F.least("y1", "y2")), cell(F.greatest("y1", "y2")))))
        .filter(_meets_cell(x0, y0, F.lit(tile)))
    )
    box = e.groupBy("_p").agg(
        F.min(F.least("x1", "x2")).alias("_xl"), F.max(F.greatest("x1", "x2")).alias("_xh"),
        F.min(F.least("y1", "y2")).alias("_yl"), F.max(F.greatest("y1", "y2")).alias("_yh"),
    )
    tiles = box.withColumn("_cx", F.explode(F.sequence(cell(F.col("_xl")), cell(F.col("_xh"))))).withColumn(
        "_cy", F.explode(F.sequence(cell(F.col("_yl")), cell(F.col("_yh"))))
    )
    # along a line of corners, crossings are counted from the east: one running count a polygon and line
    lines = F.sequence(F.ceil(F.least("y1", "y2") / tile), F.floor(F.greatest("y1", "y2") / tile))
    crossed = e.withColumn("_cy", F.explode(F.when(F.ceil(F.least("y1", "y2") / tile) <= F.floor(F.greatest("y1", "y2") / tile), lines)))
    height = F.col("_cy") * tile
    straddles = (F.col("y1") > height) != (F.col("y2") > height)
    at_x = F.col("x1") + F.try_divide((height - F.col("y1")) * (F.col("x2") - F.col("x1")), F.col("y2") - F.col("y1"))
    marks = crossed.filter(straddles).select("_p", "_cy", at_x.alias("_x"), F.lit(None).cast("long").alias("_cx"), F.lit(1).alias("_n"))
    marks = marks.union(tiles.select("_p", "_cy", x0.alias("_x"), "_cx", F.lit(0).alias("_n")))
    east = Window.partitionBy("_p", "_cy").orderBy(F.col("_x").desc(), "_n").rowsBetween(Window.unboundedPreceding, 0)
    corners = marks.withColumn("_c", F.sum("_n").over(east)).filter("_cx IS NOT NULL").select("_p", "_cx", "_cy", (F.col("_c") % 2 == 1).alias("_odd"))
    pieces = store(pieces.select("_p", "_cx", "_cy", *_EDGE), "tile-edges")
    corners = store(corners, "tile-corners")
    leaves = []
    for level in range(depth + 1):
        size = tile / 2**level
        counts = pieces.groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("_n"))
        crowded = store(counts.filter(F.col("_n") > most).select("_cx", "_cy"), "crowded-cells")
        last = level == depth or crowded.isEmpty()
        # polygons without an edge in a crowded cell cover it or miss it: they stay on this level
        here = pieces if last else pieces.hint("merge").join(crowded, ["_cx", "_cy"], "left_anti")
        lists = here.groupBy("_p", "_cx", "_cy").agg(F.collect_list(F.struct(*_EDGE)).alias("_edges"))
        known = corners
        if not last:
            cut = pieces.hint("merge").join(crowded, ["_cx", "_cy"])
            cut_cells = store(cut.select("_p", "_cx", "_cy").distinct(), "cut-cells")
            known = corners.hint("merge").join(cut_cells, ["_p", "_cx", "_cy"], "left_anti")
        found = known.hint("merge").join(lists, ["_p", "_cx", "_cy"], "left").filter("_odd OR _edges IS NOT NULL")
        leaves.append(found.select(F.lit(level).alias("_level"), "_cx", "_cy", "_p", "_odd", "_edges"))
        if last:
            break
        half = size / 2
        kids = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
        kid_x, kid_y = F.col("_cx") * 2 + F.col("_k.i"), F.col("_cy") * 2 + F.col("_k.j")
        low_x, low_y = F.col("_cx") * size, F.col("_cy") * size
        turned = _crossings(*[F.col(c) for c in _EDGE], low_x, low_y, kid_x * half, kid_y * half)
        flips = cut.withColumn("_k", kids).groupBy("_p", "_cx", "_cy", "_k").agg(F.sum(turned).alias("_t"))
        next_corners = flips.hint("merge").join(corners, ["_p", "_cx", "_cy"]).select(
            "_p", kid_x.alias("_cx"), kid_y.alias("_cy"), (F.col("_odd") != (F.col("_t") % 2 == 1)).alias("_odd")
        )
        next_pieces = cut.withColumn("_k", kids).select("_p", kid_x.alias("_cx"), kid_y.alias("_cy"), *_EDGE)
        next_pieces = next_pieces.filter(_meets_cell(F.col("_cx") * half, F.col("_cy") * half, F.lit(half)))
        pieces, corners = store(next_pieces, "cell-edges"), store(next_corners, "cell-corners")
    every = leaves[0]
    for more in leaves[1:]:
        every = every.union(more)
    return store(every, "polygon-leaves")


def points_in_polygons(
    points: DataFrame,
    edges: DataFrame,
    point_id: str = "location_id",
    polygon_id: str = "polygon_id",
    lat_col: str = "lat",
    lon_col: str = "lon",
    tile: float = 1.0,
    most: int = 256,
    index: DataFrame | None = None,
) -> DataFrame:
    """Pairs of a point and a polygon around it, by crossing parity.

    A point looks its cell up on every level that ``polygon_index`` has and meets the polygons
    of its leaf, each with the few edges there: the parity of the cell's corner, turned once
    for each edge between the corner and the point. Cells where points crowd are split among tasks, since
    nothing is grouped by cell afterwards. On a boundary itself either answer may come.
    """
    index = polygon_index(edges, polygon_id, tile, most) if index is None else index
    levels = sorted(r["_level"] for r in index.select("_level").distinct().collect())  # depth + 1 rows at most
    placed = points.select(point_id, col(lon_col).cast("double").alias("_px"), col(lat_col).cast("double").alias("_py"))
    placed = placed.filter("_px IS NOT NULL AND _py IS NOT NULL AND NOT isnan(_px) AND NOT isnan(_py)")
    cells = [
        F.struct(
            F.lit(level).alias("_level"),
            F.floor(F.col("_px") * 2**level / tile).alias("_cx"),
            F.floor(F.col("_py") * 2**level / tile).alias("_cy"),
        )
        for level in levels
    ]
    if not cells:
        return placed.select(point_id, F.lit(None).alias("_p")).filter("_p IS NOT NULL").withColumnRenamed("_p", polygon_id)
    asked = placed.withColumn("_cell", F.explode(F.array(*cells))).select(point_id, "_px", "_py", "_cell.*")
    met = asked.hint("merge").join(index, ["_level", "_cx", "_cy"])
    side = F.lit(tile) / F.pow(F.lit(2.0), F.col("_level"))
    turns = F.aggregate(
        F.coalesce("_edges", F.array().cast(index.schema["_edges"].dataType)),
        F.lit(0),
        lambda n, s: n + _crossings(s["x1"], s["y1"], s["x2"], s["y2"], F.col("_cx") * side, F.col("_cy") * side, F.col("_px"), F.col("_py")),
    )
    inside = F.col("_odd") != (turns % 2 == 1)
    return met.filter(inside).select(point_id, F.col("_p").alias(polygon_id))


def polygon_of_point(
    points: DataFrame,
    edges: DataFrame,
    point_id: str = "location_id",
    polygon_id: str = "polygon_id",
    **options,
) -> DataFrame:
    """Each point with its polygon; NULL outside, the first id where polygons overlap.

    A polygon that covers a cell holds all its points, so polygons of later ids are not looked at there.
    """
    index = options.pop("index", None)
    if index is None:
        index = polygon_index(edges, polygon_id, options.get("tile", 1.0), options.get("most", 256))
    cell = ["_level", "_cx", "_cy"]
    covering = index.filter("_edges IS NULL").groupBy(*cell).agg(F.min("_p").alias("_first"))
    near = index.hint("merge").join(covering, cell, "left").filter("_first IS NULL OR _p <= _first").drop("_first")
    pairs = points_in_polygons(points, edges, point_id, polygon_id, index=store(near, "first-polygons"), **options)
    first = pairs.groupBy(point_id).agg(F.min(polygon_id).alias(polygon_id))
    return points.hint("merge").join(first, point_id, "left")
