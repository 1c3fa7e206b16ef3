"""Joins that an engine of tiles needs: cover, overzoom, archive choice, missing images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cover(views: DataFrame, z: int, most: int = 256) -> DataFrame:
    """Tiles of views (view, x0, y0, x1, y1 in world units; x may leave 0..1): rows top to bottom, x wrapped, the first ``most`` in that order."""
    n = 1 << z
    ys = F.sequence(F.greatest(F.floor(F.col("y0") * n), F.lit(0)), F.least(F.floor(F.col("y1") * n), F.lit(n - 1)))
    xs = F.sequence(F.floor(F.col("x0") * n), F.floor(F.col("x1") * n))
    rows = views.where((F.col("y1") >= 0) & (F.col("y0") < 1) & (F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1")))
    tiles = rows.select("view", F.explode(ys).alias("y"), xs.alias("xs")).select("view", "y", F.explode("xs").alias("ux"))
    w = Window.partitionBy("view").orderBy("y", "ux")
    ranked = tiles.withColumn("ordinal", (F.row_number().over(w) - 1).cast("int")).where(F.col("ordinal") < most)
    return ranked.select("view", F.lit(z).alias("z"), F.pmod("ux", F.lit(n)).cast("int").alias("x"), F.col("y").cast("int").alias("y"), "ordinal")


def overzoom(wanted: DataFrame, have: DataFrame, z: int, have_z: int) -> DataFrame:
    """Wanted tiles (x, y at zoom z) with the ancestors (x, y at have_z) that contain them: an equi join on shifted keys."""
    d = z - have_z
    keyed = wanted.withColumns({"_x": F.shiftright("x", d), "_y": F.shiftright("y", d)})
    return keyed.join(have.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.lit(have_z).alias("have_z")), ["_x", "_y"]).withColumnsRenamed({"_x": "have_x", "_y": "have_y"})


def entry_join(tiles: DataFrame, entries: DataFrame, bucket: int = 4096) -> DataFrame:
    """Tile ids with their archive entry (tile_id, run, offset, length): a range join over buckets of ids."""
    first, last = F.floor(F.col("tile_id") / bucket), F.floor((F.col("tile_id") + F.col("run") - 1) / bucket)
    e = entries.withColumn("_b", F.explode(F.sequence(first, last))).withColumnRenamed("tile_id", "start")
    t = tiles.withColumn("_b", F.floor(F.col("tile_id") / bucket))
    return t.join(e, "_b").where((F.col("tile_id") >= F.col("start")) & (F.col("tile_id") < F.col("start") + F.col("run"))).drop("_b")


def pick_archive(candidates: DataFrame, tile: list[str], rank: list[Column]) -> DataFrame:
    """The first archive of each tile by ``rank`` among those with a payload."""
    w = Window.partitionBy(*tile).orderBy(*rank)
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def missing_images(used: DataFrame, sprite: DataFrame) -> DataFrame:
    """Distinct names that the sprite does not have."""
    return used.select("name").where(F.col("name").isNotNull()).distinct().join(sprite.select("name"), "name", "left_anti")
