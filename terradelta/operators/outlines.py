"""Outlines and areas of connected patches of grid cells.

Each cell has four sides, directed so that the cell lies to their left.  A side
that two cells of one patch share comes twice, in opposite directions, and
cancels; what is left is the boundary.  Sides are chained into rings: the side
after one is the one that starts where it ends, and where a patch touches itself
in a corner and two start there, the left turn, so that rings never cross, each
side has one before and one after it, and cells that share sides have one outer
ring (holes that touch in a corner are one hole).  Rings are told apart and numbered by
pointer doubling: each round doubles the reach and carries the steps to the least
side, so a ring of a million sides takes twenty rounds in all.  No ring is put together in one task; its corners are rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta.session import stored

#: Side k of a cell: from its corner k to the next, against the clock from the south-west.
CORNERS = ((0, 0), (1, 0), (1, 1), (0, 1))
STRAIGHT, LEFT, RIGHT = 0, 1, 3


def boundary(cells: DataFrame) -> DataFrame:
    """(patch, side, x, y, x2, y2, way) of the sides between a patch and what is not it.

    cells: (patch, x, y), each once.  side is a number of its own for each row of
    a patch: four for each cell in the order of columns and rows.
    """
    four = F.inline(F.array(*[F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"), (F.col("x") + c).alias("x2"), (F.col("y") + d).alias("y2"), F.lit(k).alias("way")) for k, ((a, b), (c, d)) in enumerate(zip(CORNERS, CORNERS[1:] + CORNERS[:1], strict=True))]))
    sides = cells.select("patch", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).select("patch", four)
    ends = F.struct("x", "y"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    low, high = F.least(*ends), F.greatest(*ends)
    once = sides.groupBy("patch", low.alias("low"), high.alias("high")).agg(F.count("*").alias("c"), F.min("way").alias("way")).where("c = 1")
    forth = F.col("way") < 2  # east and north: from the lesser end to the greater
    along = [F.when(forth, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}")).alias(n) for a, b, c, n in (("low", "high", "x", "x"), ("low", "high", "y", "y"), ("high", "low", "x", "x2"), ("high", "low", "y", "y2"))]
    return once.select("patch", *along, "way")


def rings(cells: DataFrame) -> DataFrame:
    """(patch, ring, place, x, y, x2, y2, way): every boundary side with its ring and its place in it.

    A ring is called by its least side (the start's x, y and the way), which has
    place 0; places follow the ring with the patch to the left.
    """
    key = F.struct("x", "y", "way")
    sides, _ = stored(boundary(cells).select("patch", key.alias("e"), "x", "y", "x2", "y2", "way"), "outline-sides")
    starts = sides.select("patch", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("e").alias("next"), F.col("way").alias("then"))
    turn = F.pmod(F.col("then") - F.col("way"), F.lit(4))
    order = F.when(turn == LEFT, 0).when(turn == STRAIGHT, 1).otherwise(2)
    follow = sides.join(starts, ["patch", "x2", "y2"]).groupBy("patch", "e").agg(F.min(F.struct(order.alias("o"), "next")).alias("n")).select("patch", "e", F.col("n.next").alias("to"))
    ahead = F.when(F.col("to") < F.col("e"), 1).otherwise(0).cast("long")
    reach, _ = stored(follow.select("patch", "e", "to", F.least("e", "to").alias("least"), ahead.alias("steps")), "outline-reach")
    far = 1
    while True:  # the least side within reach and the steps to it; the reach doubles
        on = reach.select("patch", F.col("e").alias("to"), F.col("to").alias("further"), F.col("least").alias("other"), F.col("steps").alias("more"))
        moved = F.col("other") < F.col("least")
        new = reach.join(on, ["patch", "to"]).select("patch", "e", F.col("further").alias("to"), F.least("least", "other").alias("least"), F.when(moved, F.col("more") + far).otherwise(F.col("steps")).alias("steps"), moved.alias("moved"))
        new, _ = stored(new, "outline-reach")
        reach, far = new.drop("moved"), far * 2
        if new.where("moved").isEmpty():
            break
    left = reach.select("patch", "e", F.col("least").alias("ring"), "steps")
    length = left.groupBy("patch", "ring").agg(F.count("*").alias("length"))
    d = sides.join(left, ["patch", "e"]).join(length, ["patch", "ring"])
    return d.select("patch", "ring", F.pmod(F.col("length") - F.col("steps"), F.col("length")).alias("place"), "x", "y", "x2", "y2", "way")


def ring_areas(sides: DataFrame) -> DataFrame:
    """(patch, ring, sides, cells): how many cells each ring encloses, less than nothing for a hole."""
    twice = F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))
    return sides.groupBy("patch", "ring").agg(F.count("*").alias("sides"), (twice / 2).cast("long").alias("cells"))


def patch_areas(sides: DataFrame, cell_m2: float) -> DataFrame:
    """(patch, area_m2, perimeter, outer, holes) of each patch, from its outline alone."""
    r = ring_areas(sides)
    return r.groupBy("patch").agg((F.sum("cells") * F.lit(cell_m2)).alias("area_m2"), F.sum("sides").alias("perimeter"), F.count_if(F.col("cells") > 0).alias("outer"), F.count_if(F.col("cells") < 0).alias("holes"))


def boundary_areas(sides: DataFrame, cell_m2: float) -> DataFrame:
    """(patch, area_m2) of each patch from boundary() alone: all its sides add up to the same area in whatever order, so no ring is needed."""
    twice = F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))
    return sides.groupBy("patch").agg(((twice / 2).cast("long") * F.lit(cell_m2)).alias("area_m2"))
