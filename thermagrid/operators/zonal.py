"""Polygons, rasters and nodes: overlay areas, zonal means, sampling, sky view.

A raster is a long table (raster_id, row, col, value); its affine placement is
(x0, y0, resolution) with y0 the north edge. Pixels and polygons meet cells
through equi-joins on integer tile keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.core import col, finite
from ..functions.geo import ring_bounds
from ..session import stored
from .lookups import counted_side


def _level(box: Sequence[str], size: float) -> Column:
    """The level whose tiles (``size`` times 2^level) are no smaller than the box: it meets four of them at most."""
    xmin, ymin, xmax, ymax = map(F.col, box)
    extent = F.greatest(xmax - xmin, ymax - ymin) / F.lit(float(size))
    return F.when(extent > 1, F.ceil(F.log2(extent) - F.lit(1e-12))).otherwise(0).cast("int")


def _covered(df: DataFrame, box: Sequence[str], size: float, others: Column) -> DataFrame:
    """Rows by the tiles (``_m``, ``_tx``, ``_ty``) where they may meet a box of one of the levels ``others``:
    four at most for each of these levels that is not below the row's own."""
    xmin, ymin, xmax, ymax = map(F.col, box)
    tile = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("_m"))

    def tiles(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / tile).cast("long"), F.floor(high / tile).cast("long")))

    meets = F.array_distinct(F.transform("_others", lambda x: F.greatest(x, F.col("_own"))))
    return (df.withColumn("_others", others).withColumn("_m", F.explode(meets)).drop("_others").withColumn("_tx", tiles(xmin, xmax)).withColumn("_ty", tiles(ymin, ymax)))


def overlapping_boxes(left: DataFrame, right: DataFrame, left_box: Sequence[str],
                      right_box: Sequence[str], size: float,
                      by: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows whose boxes touch, each pair once.

    Tiles have several sizes: a box lives on the level whose tiles are as large as
    it is, and looks for smaller boxes there and for larger ones on their levels. A
    box as large as a million of the smallest tiles still makes a handful of rows. A
    pair meets on the coarser of its two levels and counts only in the tile that
    holds the lower-left corner of the shared box.
    """
    left, right = left.withColumn("_own", _level(left_box, size)), right.withColumn("_own", _level(right_box, size))

    def levels(df: DataFrame) -> Column:
        """Levels that occur: a few numbers."""
        return F.coalesce(df.agg(F.collect_set("_own")).scalar(), F.array().cast("array<int>"))

    pairs = _covered(left, left_box, size, levels(right)).withColumnRenamed("_own", "_lown").join(
        _covered(right, right_box, size, levels(left)).withColumnRenamed("_own", "_rown"), [*by, "_m", "_tx", "_ty"], "inner")
    lx0, ly0, lx1, ly1 = map(F.col, left_box)
    rx0, ry0, rx1, ry1 = map(F.col, right_box)
    tile = F.lit(float(size)) * F.pow(F.lit(2.0), F.col("_m"))
    touch = (lx0 <= rx1) & (rx0 <= lx1) & (ly0 <= ry1) & (ry0 <= ly1) & (F.col("_m") == F.greatest("_lown", "_rown"))
    corner = (F.floor(F.greatest(lx0, rx0) / tile) == F.col("_tx")) & (F.floor(F.greatest(ly0, ry0) / tile) == F.col("_ty"))
    return pairs.where(touch & corner).drop("_m", "_tx", "_ty", "_lown", "_rown")


#: Polygons and cells of a tile that one task takes at most, about, and pairs that it looks at together.
TILE_POLYGONS, TILE_CELLS, PAIRS_AT_ONCE = 16_384, 16_384, 1 << 17
#: Pairs that are clipped together (their arrays stay in a core's cache); pairs looked at that are worth a task; tasks at most.
CLIPPED_AT_ONCE, TASK_PAIRS, MOST_TASKS = 1 << 13, 1 << 24, 512


def clipped_areas(points: np.ndarray, polygon: np.ndarray, box: Sequence[np.ndarray], cell: np.ndarray) -> np.ndarray:
    """``clipped_area`` of the pairs (polygon, cell): corners as (corners, x and y, polygons), boxes as four arrays.

    Corner by corner, so that every step runs along one array; an edge that is level, or above or
    below all boxes at hand, takes no further step."""
    out = np.empty(len(polygon))

    def antiderivative(v: np.ndarray, width: np.ndarray) -> np.ndarray:
        return np.where(v < 0, 0.0, np.where(v <= width, v * v / 2.0, width * v - width * width / 2.0))

    for low in range(0, len(polygon), CLIPPED_AT_ONCE):
        at = slice(low, low + CLIPPED_AT_ONCE)
        xmin, ymin, xmax, ymax = (b.take(cell[at]) for b in box)
        width, height = xmax - xmin, ymax - ymin
        x, y = ([p.take(polygon[at]) - first for p in corner] for corner, first in ((points[:, 0], xmin), (points[:, 1], ymin)))
        inside = [np.minimum(np.maximum(v, 0.0), height) for v in y]
        total = np.zeros(len(xmin))
        for e in range(len(points)):  # edge by edge, as the column function adds
            f = (e + 1) % len(points)
            rise = inside[f] - inside[e]
            if not rise.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                across = x[f] - x[e]
                if across.any():
                    slope = across / (y[f] - y[e])
                    x0, x1 = x[e] + slope * (inside[e] - y[e]), x[e] + slope * (inside[f] - y[e])
                    run = x1 - x0
                    mean = np.where(np.abs(run) <= 1e-9 * width, np.minimum(np.maximum((x0 + x1) / 2.0, 0.0), width),
                                    (antiderivative(x1, width) - antiderivative(x0, width)) / run)
                else:  # all are upright
                    mean = np.minimum(np.maximum(x[e], 0.0), width)
                total += np.where(rise == 0.0, 0.0, rise * mean)
        out[at] = np.abs(total)
    return out


def _ring_points(rings: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, corners) of the rings with equally many corners, as (corners, x and y, rows)."""
    rings = rings.combine_chunks()
    points = rings.flatten()
    xy = np.stack([points.field(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in ("x", "y")])
    counts = rings.value_lengths().to_numpy(zero_copy_only=False)
    begins = np.cumsum(counts) - counts
    for count in np.unique(counts[counts > 0]).tolist():
        rows = np.flatnonzero(counts == count)
        yield rows, xy[:, begins[rows] + np.arange(count)[:, None]].transpose(1, 0, 2).copy()  # a closed ring has one more edge, of no length


def footprint_by_cell(polygons: DataFrame, cells: DataFrame, *, ring: str, cell_id: Sequence[str],
                      cell_box: Sequence[str], size: float, by: Sequence[str] = ()) -> DataFrame:
    """Per cell: summed intersection area and number of polygons with area.

    Polygons and cells meet by tile as in ``overlapping_boxes``, but as two blocks of
    bounded size: their pairs are arrays inside a task and never rows. A tile with
    many of both is dealt to as many tasks as it has pairs of blocks.
    """
    bounds = ring_bounds(ring)
    left_box = ["_pxmin", "_pymin", "_pxmax", "_pymax"]
    boxed = polygons.select(*by, F.col(ring).alias("_ring"), F.xxhash64(*polygons.columns).alias("_deal"),
                            *[bounds[k].alias(f"_p{k}") for k in ("xmin", "ymin", "xmax", "ymax")])
    keys = list(dict.fromkeys([*by, *cell_id]))
    slim = cells.select(*dict.fromkeys([*keys, *cell_box])).withColumn("_deal", F.xxhash64(*keys, *cell_box))
    left, right = boxed.withColumn("_own", _level(left_box, size)), slim.withColumn("_own", _level(cell_box, size))

    def levels(df: DataFrame) -> Column:
        return F.coalesce(df.agg(F.collect_set("_own")).scalar(), F.array().cast("array<int>"))

    tile = [*by, "_m", "_tx", "_ty"]
    meeting = [*tile, "_i", "_j"]
    left, right = _covered(left, left_box, size, levels(right)), _covered(right, cell_box, size, levels(left))

    def blocks(df: DataFrame, most: int, name: str) -> DataFrame:
        count = F.count(F.lit(1))
        return df.groupBy(*tile).agg(F.ceil(count / most).cast("int").alias(name), count.cast("double").alias(f"{name}_n"))

    dealt = stored(blocks(left, TILE_POLYGONS, "_lefts").join(blocks(right, TILE_CELLS, "_rights"), tile))
    groups, pairs = dealt.agg(F.sum(F.col("_lefts") * F.col("_rights")), F.sum(F.col("_lefts_n") * F.col("_rights_n"))).first()
    tasks = int(min(MOST_TASKS, 4 * (groups or 0), (pairs or 0) // TASK_PAIRS))
    dealt = counted_side(dealt.drop("_lefts_n", "_rights_n"))

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        """Rows with the number of their block, once for each block of the other side."""
        number, copies = ("_i", "_j") if own == "_lefts" else ("_j", "_i")
        out = (df.join(dealt, tile).withColumn(number, F.pmod("_deal", own).cast("int"))
               .withColumn(copies, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_deal", "_lefts", "_rights"))
        return out.repartition(tasks, *meeting) if tasks > 1 else out  # few bytes may be much work: not put together by size

    def placed(table: pa.Table, columns: Sequence[str], level: int, tx: int, ty: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Boxes as (4, rows), without number where they have no inside; whether a row is of the tile's own level and begins in it, by axis."""
        box = np.stack([table.column(k).cast(pa.float64()).to_numpy() for k in columns])
        box[:, ~((box[0] <= box[2]) & (box[1] <= box[3]))] = np.nan
        side = float(size) * 2.0 ** level
        return box, [table.column("_own").to_numpy() == level, np.floor(box[0] / side) == tx, np.floor(box[1] / side) == ty]

    def overlay(some: pa.Table, met: pa.Table) -> pa.Table:
        """Sums of the cells of one block over the polygons of another."""
        total, count, known, touched = (np.zeros(met.num_rows) for _ in range(4))
        if some.num_rows and met.num_rows:
            tile_at = [some.column(k)[0].as_py() for k in ("_m", "_tx", "_ty")]
            (outer, own), (box, others) = placed(some, left_box, *tile_at), placed(met, cell_box, *tile_at)
            for rows, points in _ring_points(some.column("_ring")):
                for first in range(0, len(rows), PAIRS_AT_ONCE):
                    at = rows[first:first + PAIRS_AT_ONCE]
                    x0, y0, x1, y1 = outer[:, at]
                    corners, marks = points[:, :, first:first + PAIRS_AT_ONCE], [o[at] for o in own]
                    step = max(1, PAIRS_AT_ONCE // len(at))
                    for begin in range(0, len(met), step):
                        part = slice(begin, begin + step)
                        c = box[:, part, None]
                        meets = (x0 <= c[2]) & (x1 >= c[0]) & (y0 <= c[3]) & (y1 >= c[1])
                        for mark, other in zip(marks, others):  # the coarser level's, and the tile of the shared box's corner
                            meets &= mark | other[part, None]
                        cell, polygon = np.nonzero(meets)
                        if not len(cell):
                            continue
                        area = clipped_areas(corners, polygon, box[:, part], cell)
                        missing, cells_ = np.isnan(area), meets.shape[0]
                        met_by = np.bincount(cell, minlength=cells_)
                        total[part] += np.bincount(cell, np.where(missing, 0.0, area), cells_)
                        count[part] += np.bincount(cell, area > 0, cells_)
                        known[part] += met_by - np.bincount(cell[missing], minlength=cells_)
                        touched[part] += met_by
        kept = np.flatnonzero(touched)
        return pa.table({**{k: met.column(k).take(pa.array(kept)) for k in keys},
                         "_area": pa.array(total[kept], mask=known[kept] == 0), "_count": pa.array(count[kept].astype(np.int64))})

    schema = StructType([*[slim.schema[k] for k in keys], StructField("_area", DoubleType()), StructField("_count", LongType())])
    parts = (spread(left, "_lefts", "_rights").groupBy(*meeting).cogroup(spread(right, "_rights", "_lefts").groupBy(*meeting))
             .applyInArrow(overlay, schema))
    return parts.groupBy(*keys).agg(F.sum("_area").alias("footprint_m2"), F.sum("_count").alias("building_count"))


def street_canyon(height: str, footprint: str, count: str, cell_area: float) -> dict[str, Column]:
    """Aspect ratio from free space per building; no building or no free space
    gives 0."""
    h, n = F.col(height), F.coalesce(F.col(count), F.lit(0))
    free = F.greatest(F.lit(float(cell_area)) - F.coalesce(F.col(footprint), F.lit(0.0)),
                      F.lit(0.0))
    width = F.when(n > 0, F.sqrt(free / F.greatest(n, F.lit(1))))
    return {"has_buildings": (n > 0).cast("int"),
            "aspect_ratio": F.coalesce(F.try_divide(h, width), F.lit(0.0))}


def raster_boxes(raster: DataFrame, x0, y0, resolution) -> DataFrame:
    """Pixel bounds from row / col and the affine placement."""
    x0, y0 = (col(c) if isinstance(c, str) else F.lit(float(c)) for c in (x0, y0))
    r = col(resolution) if isinstance(resolution, str) else F.lit(float(resolution))
    left, top = x0 + F.col("col") * r, y0 - F.col("row") * r
    return raster.withColumns({"pxmin": left, "pymin": top - r, "pxmax": left + r, "pymax": top})


def zonal_mean(pixels: DataFrame, cells: DataFrame, *, cell_id: Sequence[str],
               cell_box: Sequence[str], value: str, size: float, minimum: float = 2.0,
               nodata: float | None = None, out: str = "mean_height",
               by: Sequence[str] = ()) -> DataFrame:
    """Mean of the pixels that touch each cell; low and missing values are
    ignored; cells without any keep 0."""
    v = finite(value)
    usable = v.isNotNull() & (v >= F.lit(float(minimum)))
    if nodata is not None:
        usable = usable & (v != F.lit(float(nodata)))
    kept = pixels.where(usable).select(*by, "pxmin", "pymin", "pxmax", "pymax", v.alias("_v"))
    slim = cells.select(*dict.fromkeys([*by, *cell_id, *cell_box]))
    pairs = overlapping_boxes(kept, slim, ["pxmin", "pymin", "pxmax", "pymax"], cell_box,
                              size, by)
    # Touching along an edge shares no ground.
    cx0, cy0, cx1, cy1 = map(F.col, cell_box)
    overlap = ((F.col("pxmin") < cx1) & (cx0 < F.col("pxmax"))
               & (F.col("pymin") < cy1) & (cy0 < F.col("pymax")))
    keys = list(dict.fromkeys([*by, *cell_id]))
    means = pairs.where(overlap).groupBy(*keys).agg(F.avg("_v").alias(out))
    return cells.select(*keys).distinct().join(means, keys, "left").withColumn(
        out, F.coalesce(out, F.lit(0.0)))


def pixel_index(x, y, x0: float, y0: float, resolution: float) -> dict[str, Column]:
    r = F.lit(float(resolution))
    return {"row": F.floor((F.lit(float(y0)) - col(y)) / r).cast("int"),
            "col": F.floor((col(x) - F.lit(float(x0))) / r).cast("int")}


def sample_raster(points: DataFrame, raster: DataFrame, *, x: str, y: str, x0: float, y0: float,
                  resolution: float, values: Sequence[str], scene: Sequence[str] = (),
                  how: str = "inner") -> DataFrame:
    """Value of the pixel under every point, for every scene of the raster."""
    keyed = points.withColumns({f"_p{k}": c for k, c in pixel_index(
        x, y, x0, y0, resolution).items()})
    pixels = raster.select(*scene, F.col("row").alias("_prow"), F.col("col").alias("_pcol"), *values)
    return keyed.join(pixels, ["_prow", "_pcol"], how).drop("_prow", "_pcol")


#: Nodes of a tile that one task takes at most, about.
TILE_NODES = 20_000


def sky_view_factor(nodes: DataFrame, raster: DataFrame, *, node_id: str, x0: float, y0: float,
                    resolution: float, height: str, max_radius: float = 200.0, step: float = 5.0,
                    azimuths: int = 36, observer: float = 1.5, nodata: float | None = None,
                    out: str = "sky_view_factor") -> DataFrame:
    """Mean over directions of cos2 of the highest horizon angle.

    The raster is cut in square tiles with a border as wide as the radius. A tile's
    nodes meet its pixels once; the rays are marched on the dense tile, so neither
    rays nor samples are ever rows. Only pixels above the observer travel, to the
    tiles whose border holds them; tiles with very many nodes are dealt to several
    tasks. Off-raster and missing samples count as ground level; of pixels or
    nodes that are there twice the highest horizon counts.
    """
    reach = math.ceil(max_radius / resolution) + 1
    side = max(64, 4 * reach)
    value = finite(height)
    if nodata is not None:
        value = F.when(value != F.lit(float(nodata)), value)

    def tiles(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / side).cast("int"), F.floor(last / side).cast("int")))

    index = pixel_index("x", "y", x0, y0, resolution)
    placed = (nodes.select(node_id, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(subset=["x", "y"])
              .withColumns({"_tr": F.floor(index["row"] / side).cast("int"), "_tc": F.floor(index["col"] / side).cast("int")}))
    shares = placed.groupBy("_tr", "_tc").agg(F.ceil(F.count(F.lit(1)) / TILE_NODES).cast("int").alias("_shares"))
    placed = placed.join(shares, ["_tr", "_tc"]).withColumn("_share", F.pmod(F.xxhash64(node_id, "x", "y"), "_shares").cast("int"))
    r, c = F.col("_r"), F.col("_c")
    tall = (raster.select(F.col("row").cast("int").alias("_r"), F.col("col").cast("int").alias("_c"),
                          (value - F.lit(float(observer))).alias("_h")).where("_h > 0")
            .withColumn("_tr", tiles(r - reach, r + reach)).withColumn("_tc", tiles(c - reach, c + reach))
            .join(shares, ["_tr", "_tc"]).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))))
    distances = np.arange(1, int(round(max_radius / step)) + 1) * float(step)
    turns = np.arange(azimuths) * (2.0 * math.pi / azimuths)

    def march(left: pa.Table, right: pa.Table) -> pa.Table:
        """What each node loses of its sky, by direction."""
        size = side + 2 * reach
        top, first = (left.column(k)[0].as_py() * side - reach for k in ("_tr", "_tc"))
        dense = np.zeros((size, size))
        if right.num_rows:
            np.maximum.at(dense, (right.column("_r").to_numpy() - top, right.column("_c").to_numpy() - first), right.column("_h").to_numpy())
        x, y = left.column("x").to_numpy()[:, None], left.column("y").to_numpy()[:, None]
        lost = np.zeros(len(x))
        for turn in turns:
            i = np.floor((y0 - (y + distances * np.cos(turn))) / resolution).astype(np.int64) - top
            j = np.floor(((x + distances * np.sin(turn)) - x0) / resolution).astype(np.int64) - first
            horizon = np.arctan2(dense[i, j], distances).max(axis=1)
            lost += 1.0 - np.cos(horizon) ** 2
        return pa.table({node_id: left.column(node_id), "_lost": pa.array(lost)})

    schema = StructType([nodes.schema[node_id], StructField("_lost", DoubleType())])
    keys = ["_tr", "_tc", "_share"]
    lost = (placed.select(*keys, node_id, "x", "y").groupBy(*keys)
            .cogroup(tall.select(*keys, "_r", "_c", "_h").groupBy(*keys)).applyInArrow(march, schema))
    open_share = F.lit(1.0) - F.coalesce(F.max("_lost"), F.lit(0.0)) / F.lit(float(azimuths))
    return nodes.select(node_id).distinct().join(lost, node_id, "left").groupBy(node_id).agg(
        F.least(F.greatest(open_share, F.lit(0.0)), F.lit(1.0)).alias(out))
