"""Components across tiles and resampling against plain restatements."""

import random

import numpy as np
import pytest

from quirelake.operators import grids


def flood(cells):
    """{cell: first cell of its component} for a set of (y, x)."""
    out = {}
    for first in sorted(cells):
        todo = [] if first in out else [first]
        while todo:
            y, x = todo.pop()
            if (y, x) in cells and (y, x) not in out:
                out[y, x] = first
                todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return out


@pytest.mark.parametrize("tile", [1, 2, 5, 64])
def test_components_do_not_depend_on_tiles(spark, tile):
    rnd = random.Random(tile)
    masks = {k: {(y, x) for y in range(9) for x in range(11) if rnd.random() < share} for k, share in enumerate((0.2, 0.35, 0.5, 0.9))}
    spiral = {(0, x) for x in range(11)} | {(y, 10) for y in range(9)} | {(8, x) for x in range(11)} | {(y, 0) for y in range(2, 9)} | {(2, x) for x in range(9)} | {(y, 8) for y in range(2, 7)} | {(6, x) for x in range(2, 9)}
    masks |= {10: spiral, 11: {(k, k) for k in range(9)} | {(k, 10 - k) for k in range(9)}, 12: {(0, 0), (0, 2), (4, 4)}}
    cells = spark.createDataFrame([(k, y, x) for k, m in masks.items() for y, x in m] + [(12, 0, 0)], "id long, y int, x int")
    runs = grids.components(cells, tile).collect()
    got = {(r.id, r.y, x): tuple(r.label) for r in runs for x in range(r.start, r.stop)}
    assert got == {(k, *c): first for k, m in masks.items() for c, first in flood(m).items()}
    assert sum(r.stop - r.start for r in runs) == len(got)
    best = {}
    for r in grids.largest(spark.createDataFrame(runs)).collect():
        best.setdefault(r.id, set()).update((r.y, x) for x in range(r.start, r.stop))
    for k, m in masks.items():
        sizes = {}
        for first in flood(m).values():
            sizes[first] = sizes.get(first, 0) + 1
        first = min(sizes, key=lambda f: (-sizes[f], f))
        assert best[k] == {c for c, f in flood(m).items() if f == first}


def bilinear(image, y, x):
    total = 0.0
    for a in (int(np.floor(y)), int(np.floor(y)) + 1):
        for b in (int(np.floor(x)), int(np.floor(x)) + 1):
            if 0 <= a < image.shape[0] and 0 <= b < image.shape[1]:
                total += image[a, b] * max(0, 1 - abs(y - a)) * max(0, 1 - abs(x - b))
    return total


@pytest.mark.parametrize("tile", [2, 3, 16])
def test_samples_inside_across_tiles_and_outside(spark, tile):
    rnd = np.random.default_rng(tile)
    images = {k: rnd.normal(size=(7, 6)) for k in (1, 2)}
    cells = spark.createDataFrame([(k, y, x, float(m[y, x])) for k, m in images.items() for y in range(7) for x in range(6)], "id long, y int, x int, v double")
    places = [(k, n, float(rnd.uniform(-3, 9)), float(rnd.uniform(-3, 8))) for n in range(200) for k in (1, 2)] + [(1, 900, 0.0, 0.0), (1, 901, 6.0, 5.0), (1, 902, -1.0, 2.0), (2, 903, 2.5, 5.5), (3, 904, 1.0, 1.0)]
    for r in grids.sampled(cells, spark.createDataFrame(places, "id long, n int, sy double, sx double"), tile).collect():
        assert r.v == pytest.approx(bilinear(images[r.id], r.sy, r.sx) if r.id in images else 0.0, abs=1e-12)


def test_corners_stay_corners(spark):
    grid = np.arange(6.0).reshape(2, 3)
    cells = spark.createDataFrame([(1, y, x, float(grid[y, x])) for y in range(2) for x in range(3)], "id long, y int, x int, v double")
    got = {(r.y, r.x): r.v for r in grids.stretched(cells, (2, 3), (5, 5)).collect()}
    assert len(got) == 25 and [got[c] for c in ((0, 0), (0, 4), (4, 0), (4, 4), (2, 2))] == [0, 2, 3, 5, 2.5]


def test_padding_goes_from_the_first_empty_row_and_column(spark):
    rows = [(1, y, x, 0.0 if y == 2 or x == 3 else 0.999, 0.0 if y == 2 or x == 3 else 1.0) for y in range(4) for x in range(5)] + [(2, 0, 0, 0.5, 0.5)]
    got = grids.without_padding(spark.createDataFrame(rows, "id long, y int, x int, a double, b double"), ["a", "b"], (4, 5)).collect()
    assert {tuple(r) for r in got} == {(1, y, x, 254, 255) for y in range(2) for x in range(3)} | {(2, 0, 0, 127, 127)}
