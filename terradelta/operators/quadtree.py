"""An adaptive quadtree over points, as tables: squares that hold few points, and joins by them.

A square is told by its level (0 is the whole), column and row.  Squares with
more than ``most`` points are divided, down to ``depth``; so no square is hot but
one of the last level whose points nearly coincide, and such a square's rows are
dealt out by salt.  Counts are taken by squares of the last level, combined
before the shuffle, and summed upwards level by level; no point is moved for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradelta.session import small_or_not, stored

DEPTH, MOST = 12, 64


@dataclass(frozen=True)
class Frame:
    """The box that the squares divide."""

    west: float
    south: float
    width: float
    height: float

    def at(self, c: Column, low: float, size: float, level: int) -> Column:
        """Column or row of a place; places outside belong to the squares of the rim."""
        n = 1 << level
        return F.least(F.greatest(F.floor((c - F.lit(low)) / F.lit(size) * n), F.lit(0)), F.lit(n - 1)).cast("int")

    def column(self, lon: Column, level: int) -> Column:
        return self.at(lon, self.west, self.width, level)

    def row(self, lat: Column, level: int) -> Column:
        return self.at(lat, self.south, self.height, level)


def frame_of(points: DataFrame) -> Frame:
    b = points.agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first()
    west, south, east, north = (x if x is not None else 0.0 for x in b)
    return Frame(west, south, (east - west) * (1 + 1e-9) or 1.0, (north - south) * (1 + 1e-9) or 1.0)


class Quadtree:
    """leaves: (level, gx, gy, n, salts, lon, lat), which cover the frame; lon and lat are of one point in the leaf, or in its parent if it has none."""

    def __init__(self, points: DataFrame, most: int = MOST, depth: int = DEPTH):
        """points: (lon, lat) without nulls."""
        self.frame, self.depth, self.most = frame_of(points), depth, most
        one = F.min(F.struct("lon", "lat")).alias("p")
        fine = points.select(self.frame.column(F.col("lon"), depth).alias("gx"), self.frame.row(F.col("lat"), depth).alias("gy"), "lon", "lat")
        counts, _ = stored(fine.groupBy("gx", "gy").agg(F.count("*").alias("n"), one), "quadtree-counts")
        up = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
        nodes = counts.select(up, "gx", "gy", "n", "p").select("level", F.expr(f"shiftright(gx, {depth} - level)").alias("gx"), F.expr(f"shiftright(gy, {depth} - level)").alias("gy"), "n", "p")
        nodes, _ = stored(nodes.groupBy("level", "gx", "gy").agg(F.sum("n").alias("n"), F.min("p").alias("p")), "quadtree-nodes")
        self.divided = nodes.where((F.col("n") > most) & (F.col("level") < depth))
        four = F.inline(F.array(*[F.struct((F.col("level") + 1).alias("level"), (F.col("gx") * 2 + x).alias("gx"), (F.col("gy") * 2 + y).alias("gy")) for x in (0, 1) for y in (0, 1)]))
        children = self.divided.select(F.col("p").alias("above"), four)
        root = points.sparkSession.range(1).select(F.expr("cast(null as struct<lon:double,lat:double>)").alias("above"), *[F.lit(0).alias(c) for c in ("level", "gx", "gy")])
        every = children.unionByName(root)
        inner = self.divided.select("level", "gx", "gy")
        leaves = every.join(inner, ["level", "gx", "gy"], "left_anti").join(nodes, ["level", "gx", "gy"], "left")
        p = F.coalesce("p", "above")
        leaves = leaves.select("level", "gx", "gy", F.coalesce("n", F.lit(0)).alias("n"), p["lon"].alias("lon"), p["lat"].alias("lat"))
        self.leaves, _ = stored(leaves.withColumn("salts", F.greatest(F.ceil(F.col("n") / most), F.lit(1)).cast("int")), "quadtree-leaves")

    def of_points(self, points: DataFrame, salt: Column) -> DataFrame:
        """points(lon, lat, ...) with the leaf each lies in: (level, gx, gy, salt, leaf_lon, leaf_lat).

        A point tries its own square on each level that has leaves.  Rows of a
        leaf that could not be divided are dealt out by the hash of salt.
        """
        levels = [r["level"] for r in self.leaves.select("level").distinct().collect()]  # at most depth + 1 rows
        at = F.array(*[F.struct(F.lit(v).alias("level"), self.frame.column(F.col("lon"), v).alias("gx"), self.frame.row(F.col("lat"), v).alias("gy")) for v in sorted(levels)])
        leaf = self.leaves.select("level", "gx", "gy", "salts", F.col("lon").alias("leaf_lon"), F.col("lat").alias("leaf_lat"))
        d = points.select("*", F.inline(at)).join(small_or_not(leaf, "quadtree-leaf"), ["level", "gx", "gy"])
        return d.withColumn("salt", F.pmod(F.xxhash64(salt), F.col("salts")).cast("int")).drop("salts")

    def meeting(self, boxes: DataFrame, salted: bool = True) -> DataFrame:
        """boxes(w, s, e, n, ...) with every leaf that each meets: (level, gx, gy, salt).

        A box takes the level whose squares are no smaller than it, so it lies in
        four squares at most; leaves above and below these are found by equal
        squares, and those below are held against the box.  No leaf comes twice.
        """
        f = self.frame
        at = lambda c, low, size, v: F.least(F.greatest(F.floor((c - F.lit(low)) / F.lit(size) * F.pow(F.lit(2.0), v)), F.lit(0)), F.pow(F.lit(2.0), v) - 1).cast("int")
        sides = lambda v: (*[at(F.col(c), f.west, f.width, v) for c in ("w", "e")], *[at(F.col(c), f.south, f.height, v) for c in ("s", "n")])
        size = F.greatest((F.col("e") - F.col("w")) / f.width, (F.col("n") - F.col("s")) / f.height, F.lit(2.0**-self.depth))
        b = boxes.withColumn("_v", F.greatest(F.lit(0), F.floor(-F.log2(size) + 1e-9)).cast("int"))

        def squares(d: DataFrame, level: str, gx: str, gy: str) -> DataFrame:
            x0, x1, y0, y1 = sides(F.col(level))
            return d.withColumn(gx, F.explode(F.sequence(x0, x1))).withColumn(gy, F.explode(F.sequence(y0, y1)))

        leaf = self.leaves.select(F.col("level").alias("l"), F.col("gx").alias("lx"), F.col("gy").alias("ly"), "salts")
        # below: the leaf's square on the box's level; above: the box's squares on the levels over it
        ways = leaf.select("*", F.explode(F.sequence(F.lit(0), F.col("l"))).alias("_v"))
        ways = ways.withColumns({"_x": F.expr("shiftright(lx, l - _v)"), "_y": F.expr("shiftright(ly, l - _v)")})
        below = squares(b, "_v", "_x", "_y").join(small_or_not(ways, "quadtree-ways"), ["_v", "_x", "_y"]).drop("_v", "_x", "_y")
        over = b.where("_v > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("_v") - 1)).alias("l")).drop("_v")
        d = below.unionByName(squares(over, "l", "lx", "ly").join(small_or_not(leaf, "quadtree-leaf"), ["l", "lx", "ly"]))
        x0, x1, y0, y1 = sides(F.col("l"))
        d = d.where(F.col("lx").between(x0, x1) & F.col("ly").between(y0, y1))
        d = d.withColumnsRenamed({"l": "level", "lx": "gx", "ly": "gy"})
        if not salted:
            return d.drop("salts")
        return d.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
