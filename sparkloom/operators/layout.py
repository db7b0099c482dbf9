"""Geometry: squarified treemaps, packed circles, terrain.  Sequential per container, parallel over containers."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECTS = "id string, value double, x double, y double, w double, h double"


def squarify(items: list[tuple[str, float]], x: float, y: float, w: float, h: float) -> list[tuple]:
    """(id, value, x, y, w, h): rows of items of falling value, each closed when one more would make it less square."""
    items = sorted((i for i in items if i[1] > 0), key=lambda i: -i[1])
    out, at = [], 0
    left = sum(v for _, v in items)
    while at < len(items) and w > 0 and h > 0:
        scale, side = w * h / left, min(w, h)
        total, best, end = 0.0, math.inf, at
        big = items[at][1]
        while end < len(items):
            trial = total + items[end][1]
            thick = trial * scale / side
            # The least square of a row is its greatest or its smallest item.
            worst = max(max(thick / (v * scale / thick), (v * scale / thick) / thick) for v in (big, items[end][1]))
            if worst > best:
                break
            total, best, end = trial, worst, end + 1
        thick, offset = total * scale / side, 0.0
        if end == len(items) and end - at == 1:
            out.append((*items[at], x, y, w, h))
            break
        for name, value in items[at:end]:
            long = value * scale / thick
            out.append((name, value, x, y + offset, thick, long) if w >= h else (name, value, x + offset, y, long, thick))
            offset += long
        if w >= h:
            x, w = x + thick, w - thick
        else:
            y, h = y + thick, h - thick
        left -= total
        at = end
    return out


def treemap(nodes: DataFrame, width: float = 1200, height: float = 800) -> DataFrame:
    """(id, directory, value, x, y, w, h) of directories (directory null) and of the files in them.

    Directories are laid out together, as they share one container; their files
    per directory, in parallel.
    """
    sized = nodes.select("id", F.when(F.col("directory") == "", "(root)").otherwise(F.col("directory")).alias("directory"), F.greatest(F.col("loc"), F.lit(1)).cast("double").alias("value"))
    totals = sized.groupBy("directory").agg(F.sum("value").alias("value"))

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("directory")
        return pd.DataFrame(squarify(list(zip(pdf["directory"], pdf["value"], strict=True)), 0, 0, width, height), columns=["id", "value", "x", "y", "w", "h"])

    boxes = totals.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(top, RECTS)

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        r = pdf.iloc[0]
        out = pd.DataFrame(squarify(list(zip(pdf["id"], pdf["value"], strict=True)), r.bx, r.by, r.bw, r.bh), columns=["id", "value", "x", "y", "w", "h"])
        return out.assign(directory=r.directory)

    frames = boxes.select(F.col("id").alias("directory"), *[F.col(c).alias(f"b{c}") for c in "xywh"])
    files = sized.join(frames, "directory").groupBy("directory").applyInPandas(inner, RECTS + ", directory string")
    return boxes.withColumn("directory", F.lit(None).cast("string")).unionByName(files)


class _Placed:
    """Circles by place: a grid for each power of two of the radius, whose cells are four such radii wide.

    What is asked for is never wider than a cell, so nine cells of each grid have all of it.
    """

    def __init__(self, n: int):
        self.at, self.radii, self.grids = np.zeros((n, 2)), np.zeros(n), {}

    def add(self, k: int, x: float, y: float, r: float) -> None:
        self.at[k], self.radii[k] = (x, y), r
        level = math.frexp(r)[1]
        side = 4.0 * 2.0**level
        self.grids.setdefault(level, {}).setdefault((math.floor(x / side), math.floor(y / side)), []).append(k)

    def within(self, x: float, y: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Circles whose edge is less than `reach` from a point, and their gaps to it; reach is at most three times the least radius."""
        found: list[int] = []
        for level, cells in self.grids.items():
            side = 4.0 * 2.0**level
            cx, cy = math.floor(x / side), math.floor(y / side)
            for i in (cx - 1, cx, cx + 1):
                for j in (cy - 1, cy, cy + 1):
                    found += cells.get((i, j), ())
        at = np.array(found, np.int64)
        gap = np.hypot(self.at[at, 0] - x, self.at[at, 1] - y) - self.radii[at]
        near = gap <= reach
        return at[near], gap[near]


def pack(items: list[tuple[str, float]]) -> list[tuple]:
    """(id, x, y, r): circles of area in proportion to value, each as near the centre as it fits beside two others.

    Radii fall, so pairs of circles too far apart for one are too far for all that
    follow.  A pair's spot is remembered with a circle that covers it: for the next
    radius most are covered by the same one still, and the others are looked up in
    the grid.  Between equal radii a spot once taken stays taken, which is seen when
    its turn comes.
    """
    ordered = sorted(items, key=lambda i: (-i[1], i[0]))
    radii = np.sqrt(np.maximum([float(v) for _, v in ordered], 0.0))
    placed, last = _Placed(len(ordered)), math.inf
    known = [np.empty((4, 0), np.int64)]  # of pairs that a circle of radius `last` can touch: both, the side, what covers the spot or -1
    heap: list[tuple[float, float, float]] = []

    def offer(spots: np.ndarray) -> None:
        for spot in zip(np.round(np.hypot(spots[:, 0], spots[:, 1]), 9).tolist(), *spots.T.tolist(), strict=True):
            heapq.heappush(heap, spot)

    for k, r in enumerate(radii.tolist()):
        if k > 1 and r < last:
            pairs, spots = _beside(placed, np.concatenate(known, axis=1), r)
            by = pairs[3]
            known_by = np.hypot(*(spots - placed.at[by]).T) < placed.radii[by] + r - 1e-9
            for n in np.flatnonzero((by < 0) | ~known_by).tolist():
                close, gap = placed.within(*spots[n].tolist(), r)
                by[n] = close[gap.argmin()] if len(gap) and gap.min() < r - 1e-9 else -1
            known, heap, last = [pairs], [], r
            offer(spots[by < 0])
        x, y = (radii[0] + r, 0.0) if k == 1 else (0.0, 0.0)
        while k > 1:
            _, x, y = heap[0]
            if not (placed.within(x, y, r)[1] < r - 1e-9).any():
                break
            heapq.heappop(heap)
        close, _ = placed.within(x, y, 3 * r)
        placed.add(k, x, y, r)
        if not k:
            continue
        fresh = np.stack([np.tile(close, 2), np.full(2 * len(close), k), np.repeat([1, -1], len(close)), np.full(2 * len(close), -1)])
        if k > 1:
            fresh, spots = _beside(placed, fresh, r)
            around = np.append(close, k)
            short = np.hypot(spots[:, :1] - placed.at[around, 0], spots[:, 1:] - placed.at[around, 1]) - placed.radii[around] - r
            fresh[3] = np.where(short.min(1, initial=math.inf) < -1e-9, around[short.argmin(1)], -1)
            offer(spots[fresh[3] < 0])
        known.append(fresh)
    return [(name, float(x), float(y), float(r)) for (name, _), (x, y), r in zip(ordered, placed.at, radii, strict=True)]


def _beside(placed: _Placed, pairs: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (both, side, ...) those that a circle of radius r can touch, and its centres."""
    a, b, side = pairs[:3]
    d = np.hypot(*(placed.at[b] - placed.at[a]).T)
    p, q = placed.radii[a] + r, placed.radii[b] + r
    ok = (d > 0) & (d <= p + q)
    pairs, a, b, side, d, p, q = pairs[:, ok], a[ok], b[ok], side[ok], d[ok], p[ok], q[ok]
    along = (p * p - q * q + d * d) / (2 * d)
    up = side * np.sqrt(np.maximum(p * p - along * along, 0.0))
    ux, uy = (placed.at[b] - placed.at[a]).T / d
    return pairs, np.column_stack([placed.at[a, 0] + along * ux - up * uy, placed.at[a, 1] + along * uy + up * ux])


def pack_circles(nodes: DataFrame) -> DataFrame:
    """(directory, id, x, y, r): the files of each directory packed about its centre.

    Directories are dealt to as many tasks as shuffles have: their rows are few bytes for much work, and would be put together by size.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pack(list(zip(pdf["id"], pdf["value"], strict=True)))
        return pd.DataFrame(rows, columns=["id", "x", "y", "r"]).assign(directory=pdf["directory"].iloc[0])

    sized = nodes.select("directory", "id", F.greatest(F.col("loc"), F.lit(1)).cast("double").alias("value"))
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sized.repartition(tasks, "directory").groupBy("directory").applyInPandas(one, "id string, x double, y double, r double, directory string")


def mulberry32(seed: int):
    """The 32-bit generator of that name: floats in [0, 1)."""
    mask = 0xFFFFFFFF
    state = seed & mask

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & mask
        t = ((state ^ (state >> 15)) * (state | 1)) & mask
        t ^= (t + ((t ^ (t >> 7)) * (t | 61))) & mask
        return ((t ^ (t >> 14)) & mask) / 4294967296

    return draw


def terrain(spark, width: int, height: int, seed: int = 42, octaves: int = 4) -> DataFrame:
    """(x, y, height): value noise summed over octaves; the lattice values come from the seed alone, so tiles are parallel."""
    draw = mulberry32(seed)
    lattice = [[draw() for _ in range(64)] for _ in range(64)]
    tiles = spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))

    def run(batches):
        grid = np.array(lattice)
        for pdf in batches:
            total, most = np.zeros(len(pdf)), 0.0
            for k in range(octaves):
                fx, fy = pdf["x"].to_numpy() * 0.05 * 2**k, pdf["y"].to_numpy() * 0.05 * 2**k
                ix, iy = np.floor(fx).astype(int), np.floor(fy).astype(int)
                tx, ty = fx - ix, fy - iy
                tx, ty = tx * tx * (3 - 2 * tx), ty * ty * (3 - 2 * ty)
                at = lambda dx, dy: grid[(iy + dy) % 64, (ix + dx) % 64]  # noqa: E731, B023
                top, low = at(0, 0) * (1 - tx) + at(1, 0) * tx, at(0, 1) * (1 - tx) + at(1, 1) * tx
                total += (top * (1 - ty) + low * ty) * 0.5**k
                most += 0.5**k
            yield pdf.assign(height=total / most)

    return tiles.mapInPandas(run, "x int, y int, height double")


def grid_places(places: DataFrame, side: int = 100) -> DataFrame:
    """(id, grid_x, grid_y) by community and importance, without overlap: communities in cells, members in rows of them.

    A plain deterministic placement; it does not grow towns as a drawn map would.
    """
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("community").orderBy(F.col("importance").desc(), "id")) - 1
    cells = places.select("community").distinct().withColumn("cell", F.dense_rank().over(W.orderBy("community")) - 1)
    per, wide = 4, side // 40
    out = places.withColumn("n", n).join(cells, "community")
    step = F.col("n")
    return out.select("id", ((F.col("cell") % wide) * 40 + (step % 10) * per).cast("int").alias("grid_x"), (F.floor(F.col("cell") / wide) * 40 + F.floor(step / 10) * per).cast("int").alias("grid_y"))
