"""Positions in a global order, without a task that sees more than its share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestlens.session import store

_BITS = 33  # of a generated id that count rows inside a partition


def sorted_pieces(
    df: DataFrame, by: Sequence[Column], purpose: str = "ordered-rows", pieces: int | None = None
) -> DataFrame:
    """The rows sorted and cut into pieces, stored: ``_piece`` ascends with the order, ``_at`` is the place in it.

    Spark takes the bounds of the pieces from a sample; equal rows may be in several pieces, so
    a piece has about the same size whatever the values. The number of pieces follows the session's
    shuffle partitions, not the rows, unless ``pieces`` names it. ``df`` is read twice, so it should come from storage.
    """
    by = [*by, F.col("_tie")]
    named = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = named.repartitionByRange(*[pieces] if pieces else [], *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    rows = store(dealt.drop("_tie"), purpose)
    return rows.withColumn("_piece", F.shiftright("_at", _BITS)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1)))


def global_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    total: str | None = None,
    running: Mapping[str, str] | None = None,
) -> DataFrame:
    """Position (from 1) of each row in its group, by ``order``; ``total`` names the rows of the group.

    ``running`` maps a new name to a column: its sum over the rows of the group that come earlier.

    Two levels, for groups of any size and number:

    1. The rows are sorted into pieces by ranges of (keys, order).
    2. Rows and values are summed per (group, piece), at most as many sums as groups and pieces
       together, and running totals of these are each piece's offset.

    Rows equal in keys and order are numbered arbitrarily among themselves. A group key may
    be null. ``df`` is read twice, so it should come from storage.
    """
    keys, running = list(keys), dict(running or {})
    rows = sorted_pieces(df, [*[F.col(f"`{k}`") for k in keys], *order])
    sums = {"_count": F.count(F.lit(1)), "_first": F.min("_at")}
    sums |= {f"_sum_{new}": F.sum(F.coalesce(F.col(f"`{c}`"), F.lit(0))) for new, c in running.items()}
    counts = rows.groupBy(*keys, "_piece").agg(*[x.alias(n) for n, x in sums.items()])
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    offsets = counts.select(
        *[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)],
        F.col("_piece").alias("_of"),
        (before("_count") - F.col("_first") + 1).alias("_offset"),
        *[before(f"_sum_{new}").alias(f"_before_{new}") for new in running],
        *([F.sum("_count").over(whole).alias(total)] if total else []),
    )
    inside = Window.partitionBy(*keys, "_piece").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    if running:
        rows = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_own_{new}") for new, c in running.items()])
    same = F.col("_piece") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_key{i}"))
    kept = [c for c in df.columns if c not in (name, total, *running)]
    return rows.join(offsets, same).select(
        *[F.col(f"`{c}`") for c in kept],
        (F.col("_at") + F.col("_offset")).alias(name),
        *[(F.col(f"_own_{new}") + F.col(f"_before_{new}")).alias(new) for new in running],
        *([total] if total else []),
    )
