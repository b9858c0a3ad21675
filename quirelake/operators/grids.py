"""Masks and images as tables: labelled components across tiles, bilinear resampling by a gather join."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.session import kept

#: Edge of a tile of a mask, and of an image.
MASK_TILE, IMAGE_TILE = 256, 16
_RUN = "id long, y int, start int, stop int, label_y int, label_x int"


def cells_of(rows: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """id, y, x, v of arrays that hold images row by row."""
    return rows.select(F.col(key).cast("long").alias("id"), F.posexplode(values).alias("at", "v")).select("id", F.floor(F.col("at") / width).cast("int").alias("y"), (F.col("at") % width).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def mask_runs(cells: DataFrame, tile: int = MASK_TILE) -> DataFrame:
    """id, y, start, stop: stretches of set cells (id, y, x) of a row, cut where a tile ends. Repeated cells count once."""
    strip = cells.select("id", "y", "x").distinct().groupBy("id", "y", F.floor(F.col("x") / tile).alias("strip")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    # In order, a cell less its place is the same along a stretch.
    told = strip.select("id", "y", F.posexplode("xs").alias("place", "x"))
    return told.groupBy("id", "y", F.floor(F.col("x") / tile).alias("strip"), (F.col("x") - F.col("place")).alias("stretch")).agg(F.min("x").cast("int").alias("start"), (F.max("x") + 1).cast("int").alias("stop")).select("id", "y", "start", "stop")


def labelled(runs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """For runs (y, start, stop) in reading order the first cell of the component that each belongs to."""
    above = list(range(len(runs)))

    def root(k: int) -> int:
        while above[k] != k:
            above[k] = above[above[k]]
            k = above[k]
        return k

    behind = 0  # the first run of the row before that may still touch
    for k, (y, start, stop) in enumerate(runs):
        while behind < k and (runs[behind][0] < y - 1 or (runs[behind][0] == y - 1 and runs[behind][2] < start)):
            behind += 1
        at = behind
        while at < k and runs[at][0] == y - 1 and runs[at][1] <= stop:
            a, b = root(at), root(k)
            above[max(a, b)] = min(a, b)
            at += 1
    return [runs[root(k)][:2] for k in range(len(runs))]


def _labelled_tiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs in the order of their tiles, labelled tile by tile; one tile is held at a time."""
    tile, held = None, []

    def done() -> pd.DataFrame:
        firsts = labelled([r[1:] for r in held])
        return pd.DataFrame([(*r, *f) for r, f in zip(held, firsts, strict=True)], columns=["id", "y", "start", "stop", "label_y", "label_x"])

    made: list[pd.DataFrame] = []
    for frame in frames:
        for *key, y, start, stop in frame.itertuples(index=False, name=None):
            if key != tile:
                if held:
                    made.append(done())
                tile, held = key, []
            held.append((key[0], y, start, stop))
        if made:
            yield pd.concat(made)
            made = []
    if held:
        yield done()


def components(cells: DataFrame, tile: int = MASK_TILE) -> DataFrame:
    """id, y, start, stop, label: runs of set cells with the first cell (y, x), in reading order, of their component.

    Cells touch at sides and corners. Every tile is labelled by itself; runs that touch across a
    border make links between labels, and links are followed until no label changes. A task holds
    one tile, however large the mask. Cells without an id belong to no mask.
    """
    runs = mask_runs(cells, tile)
    key = ["id", "tile_y", "tile_x"]
    placed = runs.where("id is not null").select("id", F.floor(F.col("y") / tile).alias("tile_y"), F.floor(F.col("start") / tile).alias("tile_x"), "y", "start", "stop")
    told = placed.repartition(*key).sortWithinPartitions(*key, "y", "start").mapInPandas(_labelled_tiles, _RUN)
    inside = kept(told.select("id", "y", "start", "stop", F.struct(F.col("label_y").alias("y"), F.col("label_x").alias("x")).alias("label")))
    other = inside.select("id", F.col("y").alias("y2"), F.col("start").alias("start2"), F.col("stop").alias("stop2"), F.col("label").alias("label2"))
    # Down: a run in the last row of a tile with those of the next row, in its own strip and in both beside it.
    strip = F.floor(F.col("start") / tile)
    low = inside.where(F.col("y") % tile == tile - 1).select("id", "label", "start", "stop", (F.col("y") + 1).alias("y2"), F.explode(F.array(strip - 1, strip, strip + 1)).alias("strip"))
    down = low.join(other.where(F.col("y2") % tile == 0).withColumn("strip", F.floor(F.col("start2") / tile)), ["id", "y2", "strip"]).where((F.col("start2") <= F.col("stop")) & (F.col("start") <= F.col("stop2")))
    # Right: a run that ends with its tile with those that begin there, in its row and in both beside it.
    edge = inside.where(F.col("stop") % tile == 0).select("id", "label", F.col("stop").alias("start2"), F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)).alias("y2"))
    right = edge.join(other, ["id", "start2", "y2"])
    links = down.select("id", "label", "label2").unionByName(right.select("id", "label", "label2"))
    both = kept(links.unionByName(links.select("id", F.col("label2").alias("label"), F.col("label").alias("label2"))).where("label <> label2").distinct())
    # Every label that has a link takes the least one it knows of: its neighbours', and what its own has come to stand for.
    now = kept(both.groupBy("id", "label").agg(F.least(F.col("label"), F.min("label2")).alias("least")))
    while True:
        near = both.join(now.withColumnRenamed("label", "label2"), ["id", "label2"]).groupBy("id", "label").agg(F.min("least").alias("near"))
        further = now.select("id", F.col("label").alias("least"), F.col("least").alias("beyond"))
        step = kept(now.join(near, ["id", "label"]).join(further, ["id", "least"], "left").select("id", "label", F.least("least", "near", "beyond").alias("least"), (F.least("least", "near", "beyond") != F.col("least")).alias("moved")))
        now = step.select("id", "label", "least")
        if not step.where("moved").limit(1).count():
            break
    return inside.join(now, ["id", "label"], "left").select("id", "y", "start", "stop", F.coalesce("least", "label").alias("label"))


def largest(runs: DataFrame) -> DataFrame:
    """The runs (id, y, start, stop) of each mask's largest component; of equals, of that which comes first in reading order."""
    sizes = runs.groupBy("id", "label").agg(F.sum(F.col("stop") - F.col("start")).alias("size"))
    best = sizes.groupBy("id").agg(F.min(F.struct((-F.col("size")).alias("less"), "label")).alias("best")).select("id", F.col("best.label").alias("label"))
    return runs.join(best, ["id", "label"]).select("id", "y", "start", "stop")


def sampled(image: DataFrame, targets: DataFrame, tile: int = IMAGE_TILE) -> DataFrame:
    """``targets`` (id, places sy and sx in cells, anything else) with v: the bilinear mean of the four cells around; 0 outside.

    The image (id, y, x, v) is gathered into tiles that also hold the first row and column of their
    neighbours, so that every target meets a single tile.
    """
    at = lambda c: F.explode(F.when(F.col(c) % tile == 0, F.array(F.floor(F.col(c) / tile), F.floor(F.col(c) / tile) - 1)).otherwise(F.array(F.floor(F.col(c) / tile))))
    placed = image.withColumn("tile_y", at("y")).withColumn("tile_x", at("x"))
    offset = ((F.col("y") - F.col("tile_y") * tile) * (tile + 1) + F.col("x") - F.col("tile_x") * tile).cast("int")
    tiles = placed.groupBy("id", "tile_y", "tile_x").agg(F.map_from_entries(F.collect_list(F.struct(offset, "v"))).alias("cells"))
    y, x = F.floor("sy"), F.floor("sx")
    asked = targets.withColumns({"tile_y": F.floor(y / tile), "tile_x": F.floor(x / tile), "_y": y, "_x": x})
    met = asked.join(tiles, ["id", "tile_y", "tile_x"], "left")
    one = ((F.col("_y") - F.col("tile_y") * tile) * (tile + 1) + F.col("_x") - F.col("tile_x") * tile).cast("int")
    value = lambda step: F.coalesce(F.try_element_at("cells", one + step), F.lit(0.0))
    b, a = F.col("sy") - F.col("_y"), F.col("sx") - F.col("_x")
    mean = (1 - b) * ((1 - a) * value(0) + a * value(1)) + b * ((1 - a) * value(tile + 1) + a * value(tile + 2))
    return met.select(*[F.col(c) for c in targets.columns], mean.alias("v"))


def stretched(grid: DataFrame, size: tuple[int, int], onto: tuple[int, int]) -> DataFrame:
    """id, y, x, v of grids (id, y, x, v) of ``size`` (rows, columns) stretched ``onto`` another; corners fall on corners."""
    step = lambda k: F.lit((size[k] - 1) / (onto[k] - 1) if onto[k] > 1 else 0.0)
    ids = grid.select("id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(onto[0] - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(onto[1] - 1))))
    return sampled(grid, ids.withColumns({"sy": F.col("y") * step(0), "sx": F.col("x") * step(1)})).select("id", "y", "x", "v")


def dewarped(image: DataFrame, size: tuple[int, int], across: DataFrame, down: DataFrame, grid: tuple[int, int], onto: tuple[int, int]) -> DataFrame:
    """id, y, x, v: images of ``size`` seen through grids of places, which are stretched ``onto`` the result's size.

    ``across`` and ``down`` give for every knot the place in the image from -1 (the first column or
    row) to 1 (the last); what lies outside the image is 0.
    """
    place = lambda v, n: (F.col(v) + 1) / 2 * (n - 1)
    knots = stretched(across, grid, onto).withColumnRenamed("v", "gx").join(stretched(down, grid, onto).withColumnRenamed("v", "gy"), ["id", "y", "x"])
    return sampled(image, knots.select("id", F.col("y").alias("to_y"), F.col("x").alias("to_x"), place("gy", size[0]).alias("sy"), place("gx", size[1]).alias("sx"))).select("id", F.col("to_y").alias("y"), F.col("to_x").alias("x"), "v")


def without_padding(image: DataFrame, channel: list[str], size: tuple[int, int]) -> DataFrame:
    """id, y, x and the channels as bytes (255 times the value, cut off) of images before their first empty row and column."""
    total: Column = sum((F.col(c) for c in channel[1:]), F.col(channel[0]))
    sums = lambda c: image.groupBy("id", c).agg(F.sum(total).alias("s")).where("s = 0").groupBy("id").agg(F.min(c).alias(f"{c}_end"))
    cut = image.join(sums("y"), "id", "left").join(sums("x"), "id", "left")
    inside = cut.where((F.col("y") < F.coalesce("y_end", F.lit(size[0]))) & (F.col("x") < F.coalesce("x_end", F.lit(size[1]))))
    return inside.select("id", "y", "x", *[(F.col(c) * 255).cast("int").alias(c) for c in channel])
