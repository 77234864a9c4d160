"""Nearest-in-space and radius joins, exact, without all-pairs.

Points go into a quad-tree of grid cells (plain integer keys, halved with bit
shifts). The nearest join walks both trees downwards together: it keeps pairs
of (query cell, site cell), bounds their distance by the cells' tight boxes,
and drops a site cell that cannot hold the nearest site of any point in the
query cell. Only the few leaf cells that survive are joined point by point.
Cells are distinct keys, so a dense region costs more levels, not a hot task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import let
from ..functions.geo import EARTH_RADIUS_M, haversine_m, planar_m, scaled_degrees_sq
from ..session import cut_lineage, stored
from .lookups import fits

STEP_BITS = 2          # each level splits a cell in 4 x 4
MAX_BITS = 30          # cells of a 2^-30th of the extent, centimetres on Earth
COVER_ROWS = 500_000   # cells of discs that a task of radius_mean unfolds, about
SLACK = 1e-9           # bounds are relaxed by this share, the final test is exact


class _Metric:
    """How a distance is bounded by boxes and computed in the end."""

    def __init__(self, kind: str):
        if kind not in ("haversine", "scaled_degrees", "planar"):
            raise ValueError(f"unknown distance {kind!r}")
        self.kind = kind

    def axes(self, u: Column, v: Column) -> list[Column]:
        """Coordinates the boxes live in. Chord length on the sphere grows
        with the great-circle distance, so it serves for bounding."""
        if self.kind != "haversine":
            return [u, v]
        lat, lon = F.radians(u), F.radians(v)
        r = F.lit(EARTH_RADIUS_M)
        return [r * F.cos(lat) * F.cos(lon), r * F.cos(lat) * F.sin(lon), r * F.sin(lat)]

    def bound_sq(self, site: Column) -> Column:
        """Cheap squared distance that orders sites as the real one does, up to
        rounding; the query's axes and weight are columns ``_a*`` and ``_w``."""
        total = F.lit(0.0)
        for i in range(self.n_axes):
            gap = F.col(f"_a{i}") - site[f"a{i}"]
            if self.kind == "scaled_degrees" and i == 1:
                gap = gap * F.col("_w")
            total = total + gap * gap if i else gap * gap
        return total

    def weight(self, u: Column) -> Column:
        return F.cos(F.radians(u)) if self.kind == "scaled_degrees" else F.lit(1.0)

    def distance(self, qu, qv, su, sv) -> Column:
        if self.kind == "haversine":
            return haversine_m(qu, qv, su, sv)
        if self.kind == "scaled_degrees":
            return scaled_degrees_sq(qu, qv, su, sv)
        return planar_m(qu, qv, su, sv)

    def loosened(self, squared: Column) -> Column:
        """An upper limit that no rounding of the bounds can undercut. Chords
        are differences of Earth-sized numbers, good to about a nanometre."""
        relaxed = squared * F.lit(1.0 + SLACK) + F.lit(1e-18)
        if self.kind != "haversine":
            return relaxed
        return relaxed + F.sqrt(squared) * F.lit(2e-6) + F.lit(1e-12)

    @property
    def n_axes(self) -> int:
        return 3 if self.kind == "haversine" else 2


def _box_aggs(n: int, source: bool) -> list[Column]:
    lo = (lambda i: F.min(f"_a{i}")) if source else (lambda i: F.min(f"_lo{i}"))
    hi = (lambda i: F.max(f"_a{i}")) if source else (lambda i: F.max(f"_hi{i}"))
    out = []
    for i in range(n):
        out += [lo(i).alias(f"_lo{i}"), hi(i).alias(f"_hi{i}")]
    w_lo, w_hi = (F.min("_w"), F.max("_w")) if source else (F.min("_wlo"), F.max("_whi"))
    return [*out, w_lo.alias("_wlo"), w_hi.alias("_whi")]


def _cells(points: DataFrame, by: list[str], metric: _Metric) -> DataFrame:
    """Leaf cells with the tight box of their points."""
    return points.groupBy(*by, "_kx", "_ky").agg(*_box_aggs(metric.n_axes, True))


def _coarser(cells: DataFrame, by: list[str], shift: int, metric: _Metric) -> DataFrame:
    if shift == 0:
        return cells
    up = (cells.withColumn("_kx", F.shiftright("_kx", shift))
          .withColumn("_ky", F.shiftright("_ky", shift)))
    return up.groupBy(*by, "_kx", "_ky").agg(*_box_aggs(metric.n_axes, False))


def _side(cells: DataFrame, by: list[str], prefix: str, parent_bits: int | None) -> DataFrame:
    names = [c for c in cells.columns if c not in by]
    out = cells.select(*by, *[F.col(c).alias(prefix + c) for c in names])
    if parent_bits:
        out = (out.withColumn(f"{prefix}_px", F.shiftright(f"{prefix}_kx", parent_bits))
               .withColumn(f"{prefix}_py", F.shiftright(f"{prefix}_ky", parent_bits)))
    return out


def _gap_sq(metric: _Metric) -> tuple[Column, Column]:
    """Least and greatest squared distance between the boxes of q and s."""
    near, far = F.lit(0.0), F.lit(0.0)
    for i in range(metric.n_axes):
        ql, qh = F.col(f"q_lo{i}"), F.col(f"q_hi{i}")
        sl, sh = F.col(f"s_lo{i}"), F.col(f"s_hi{i}")
        lo = F.greatest(sl - qh, ql - sh, F.lit(0.0))
        hi = F.greatest(sh - ql, qh - sl)
        if metric.kind == "scaled_degrees" and i == 1:
            lo, hi = lo * F.col("q_wlo"), hi * F.col("q_whi")
        near, far = near + lo * lo, far + hi * hi
    return near, far


def _keyed(points: DataFrame, u: str, v: str, extent: tuple, bits: int,
           metric: _Metric) -> DataFrame:
    ulo, uspan, vlo, vspan = extent
    top = (1 << bits) - 1

    def key(c: str, low: float, span: float) -> Column:
        k = F.floor((F.col(c) - F.lit(low)) / F.lit(span) * F.lit(float(top + 1))).cast("int")
        return F.greatest(F.lit(0), F.least(k, F.lit(top)))

    columns = {"_kx": key(u, ulo, uspan), "_ky": key(v, vlo, vspan),
               "_w": metric.weight(F.col(u))}
    for i, axis in enumerate(metric.axes(F.col(u), F.col(v))):
        columns[f"_a{i}"] = axis
    return points.withColumns(columns)


def _survey(sites: DataFrame, others: list[tuple[DataFrame, str, str]], by: list[str], u: str,
            v: str, leaf: int) -> tuple[tuple, int]:
    """Extent of the sites and of all other points together, and the tree depth at
    which no leaf holds more than ``leaf`` sites: small aggregates read on the
    driver.

    The extent covers both sides, so that points far from all sites have small
    cells too, whose bounds prune. Sites are counted once in the finest cells; each
    coarser level adds up the cells of the level below.
    """
    def edges(df: DataFrame, x: str, y: str, counted: bool) -> DataFrame:
        return df.agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min(y).alias("c"), F.max(y).alias("d"),
                      F.count(F.lit(1) if counted else F.lit(None)).alias("n"))

    boxes = edges(sites, u, v, True)
    for df, x, y in others:
        boxes = boxes.unionByName(edges(df, x, y, False))
    row = boxes.agg(F.min("a"), F.max("b"), F.min("c"), F.max("d"), F.sum("n")).first()
    if row[0] is None:
        return (0.0, 1.0, 0.0, 1.0), 0
    extent = (row[0], max(row[1] - row[0], 1e-12), row[2], max(row[3] - row[2], 1e-12))

    def fullest(finest: int, coarsest: int) -> dict[int, int]:
        """Most sites in a cell of each level; one row per level is read."""
        cells = (_keyed(sites, u, v, extent, finest, _Metric("planar"))
                 .groupBy(*by, "_kx", "_ky").agg(F.count(F.lit(1)).alias("_n")))
        found = None
        for bits in range(finest, coarsest - 1, -STEP_BITS):
            most = cells.agg(F.lit(bits).alias("_b"), F.max("_n").alias("_n"))
            found = most if found is None else found.unionByName(most)
            cells = (cells.groupBy(*by, F.shiftright("_kx", STEP_BITS).alias("_kx"),
                                   F.shiftright("_ky", STEP_BITS).alias("_ky")).agg(F.sum("_n").alias("_n")))
        return {r["_b"]: r["_n"] or 0 for r in found.collect()}

    # Evenly spread sites need log4(sites / leaf) levels; look two steps further, then deeper while a cell is too full.
    even = math.ceil(math.log2(max(row[4] / leaf, 1.0)) / 2)
    coarsest, finest = 0, min(MAX_BITS, -(-even // STEP_BITS) * STEP_BITS + 2 * STEP_BITS)
    while True:
        fits = [b for b, n in fullest(finest, coarsest).items() if n <= leaf]
        if fits or finest >= MAX_BITS:
            return extent, (min(fits) if fits else MAX_BITS)
        coarsest, finest = finest + STEP_BITS, min(MAX_BITS, finest + 4 * STEP_BITS)


def nearest_site(
    queries: DataFrame,
    sites: DataFrame,
    *,
    query_id: Sequence[str],
    query_uv: tuple[str, str],
    site_uv: tuple[str, str],
    payload: Sequence[str],
    tie: Sequence[str],
    by: Sequence[str] = (),
    metric: str = "haversine",
    distance: str = "distance",
    leaf: int = 48,
) -> DataFrame:
    """Nearest site of every query, within the same ``by`` group.

    ``query_uv`` / ``site_uv`` are (latitude, longitude) or (x, y); ``query_id``
    and ``by`` identify a query. Returns one row per query: ``by``, id columns,
    payload columns and the distance.
    Queries in a group without sites, and rows without coordinates, are absent.
    Equal distances go to the smallest ``tie`` columns. Leaves hold at most ``leaf``
    sites (more only where so many places share a cell of the finest level).
    """
    return _nearest(queries, sites, query_id, query_uv, site_uv, payload, tie, by, metric,
                    distance, leaf, count_work=False)


def nearest_work(queries: DataFrame, sites: DataFrame, **how) -> DataFrame:
    """Distance evaluations of ``nearest_site`` with the same arguments: one row."""
    settings = {"by": (), "metric": "haversine", "distance": "distance", "leaf": 48} | how
    return _nearest(queries, sites, count_work=True, **settings)


def _nearest(queries, sites, query_id, query_uv, site_uv, payload, tie, by, metric, distance,
             leaf, count_work) -> DataFrame:
    m = _Metric(metric)
    by = list(by)
    qu, qv = query_uv
    su, sv = site_uv
    q = queries.select(*dict.fromkeys([*by, *query_id]), F.col(qu).alias("_qu"),
                       F.col(qv).alias("_qv")).dropna(subset=[*by, "_qu", "_qv"])
    # Sites at one place differ only by tie order: keep the winner of each place.
    s_row = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(payload)])
    s = (
        sites.dropna(subset=[*by, su, sv])
        .groupBy(*by, F.col(su).alias("_su"), F.col(sv).alias("_sv"))
        .agg(F.min_by(s_row, F.struct(*tie)).alias("_pay"), F.min(F.struct(*tie)).alias("_tie"))
    )
    # Both sides are surveyed, boxed and joined: write their few columns once.
    q, s = cut_lineage(q), cut_lineage(s)
    extent, bits = _survey(s, [(q, "_qu", "_qv")], by, "_su", "_sv", leaf)
    ids = list(dict.fromkeys([*by, *query_id]))
    qk = _keyed(q, "_qu", "_qv", extent, bits, m)
    sk = _keyed(s, "_su", "_sv", extent, bits, m)
    # The sites of a leaf travel as one array: the survey bounds its length.
    axes = [f"_a{i}" for i in range(m.n_axes)]
    arrays = sk.groupBy(*by, F.col("_kx").alias("_skx"), F.col("_ky").alias("_sky")).agg(
        F.collect_list(F.struct("_su", "_sv", "_tie", "_pay", *[
            F.col(a).alias(a[1:]) for a in axes])).alias("_sites"))
    point = [*ids, "_qu", "_qv", "_w", *axes]
    if bits == 0:
        # One leaf per group: one row per query comes out of the join.
        tree = qk.select(*point, F.col("_kx").alias("_skx"), F.col("_ky").alias("_sky"))
        arrays = arrays if by else F.broadcast(arrays)  # without groups: a single row
        met = tree.join(arrays, [*by, "_skx", "_sky"], "inner")
        if count_work:
            return met.agg(F.sum(F.size("_sites")).alias("evaluations"))
        best = met.select(*ids, _nearest_of_array(m).alias("_best"))
    else:
        frontier = _walk_down(_cells(qk, by, m), _cells(sk, by, m), by, bits, m)
        leaves = frontier.select(
            *by, F.col("q_kx").alias("_kx"), F.col("q_ky").alias("_ky"),
            F.col("s_kx").alias("_skx"), F.col("s_ky").alias("_sky"))
        # Points meet the keys of their site leaves first: an array is in one row before
        # the last join, not in as many as there are query cells around it.
        aimed = qk.select(*point, "_kx", "_ky").join(leaves, [*by, "_kx", "_ky"], "inner")
        # The estimate of an aggregate of arrays is far below its size: sites are counted instead
        # (nested rows take about twice the bytes of their values).
        small = fits(s, 2 * (s._jdf.schema().defaultSize() + 8 * m.n_axes))
        met = aimed.join(F.broadcast(arrays) if small else arrays.hint("merge"), [*by, "_skx", "_sky"], "inner")
        if count_work:
            return met.agg(F.sum(F.size("_sites")).alias("evaluations"))
        pairs = met.select(*ids, _nearest_of_array(m).alias("_best"))
        best = pairs.groupBy(*ids).agg(F.min("_best").alias("_best"))
    return best.select(
        *ids, *[F.col("_best.pay")[f"p{i}"].alias(c) for i, c in enumerate(payload)],
        F.col("_best.d").alias(distance))


def _nearest_of_array(m: _Metric) -> Column:
    """(distance, tie, payload) of the nearest site in ``_sites``. The cheap
    distance leaves the sites that may win, the real one decides among them."""
    def exact(t: Column) -> Column:
        return F.struct(m.distance("_qu", "_qv", t["_su"], t["_sv"]).alias("d"),
                        t["_tie"].alias("tie"), t["_pay"].alias("pay"))

    def winners(keys: Column) -> Column:
        def kept(limit: Column) -> Column:
            near = F.zip_with("_sites", keys, lambda t, k: F.when(
                k <= limit, t))
            return F.filter(near, lambda t: t.isNotNull())
        return let(m.loosened(F.array_min(keys)), kept)

    return F.array_min(F.transform(let(F.transform("_sites", m.bound_sq), winners), exact))


def _walk_down(q_cells: DataFrame, s_cells: DataFrame, by: list[str], bits: int,
               m: _Metric) -> DataFrame:
    """Pairs of leaf cells that may hold a nearest pair."""
    shifts = list(range(bits - STEP_BITS, -1, -STEP_BITS))
    if not shifts or shifts[-1] != 0:
        shifts.append(0)
    if len(shifts) > 1:
        # The leaf tables feed every level; cut them so that no level rescans.
        q_cells, s_cells = cut_lineage(q_cells), cut_lineage(s_cells)
    frontier = None
    for depth, shift in enumerate(shifts):
        qs = _side(_coarser(q_cells, by, shift, m), by, "q", STEP_BITS)
        ss = _side(_coarser(s_cells, by, shift, m), by, "s", STEP_BITS)
        if frontier is None:
            # Top level: all cells share the root, at most 4**STEP_BITS a side.
            roots = [*by, "q_px", "q_py"]
            pairs = qs.join(ss.withColumnsRenamed({"s_px": "q_px", "s_py": "q_py"}),
                            roots, "inner")
        else:
            parents = frontier.select(
                *by, F.col("q_kx").alias("q_px"), F.col("q_ky").alias("q_py"),
                F.col("s_kx").alias("s_px"), F.col("s_ky").alias("s_py"))
            pairs = (parents.join(qs, [*by, "q_px", "q_py"], "inner")
                     .join(ss, [*by, "s_px", "s_py"], "inner"))
        near, far = _gap_sq(m)
        cell = Window.partitionBy(*by, "q_kx", "q_ky")
        frontier = (
            pairs.withColumn("_near", near).withColumn("_far", far)
            .withColumn("_limit", F.min("_far").over(cell))
            .where(F.col("_near") <= m.loosened(F.col("_limit")))
            .select(*by, "q_kx", "q_ky", "s_kx", "s_ky")
        )
        if depth % 3 == 2 and shift:
            frontier = cut_lineage(frontier)
    return frontier


def radius_mean(
    targets: DataFrame,
    sources: DataFrame,
    *,
    target_id: Sequence[str],
    target_xy: tuple[str, str],
    source_xy: tuple[str, str],
    source_id: Sequence[str],
    values: Sequence[str],
    radius: float,
    by: Sequence[str] = (),
    suffix: str = "_mean",
    count: str = "n_sources",
    leaf: int = 64,
) -> DataFrame:
    """Mean of every value over the sources within ``radius`` of each target,
    and their number; an empty disc takes its single nearest source.

    Sources are summed per place and in a pyramid of square cells, one table with
    a row for each (level, cell). A disc is covered by the largest cells that lie
    inside it, whose sums are added, and by the smallest cells that its edge
    crosses, whose places are tested one by one; both come out of one join. The
    block of 3 x 3 first cells around a target holds its disc; the number of
    places there sets the levels, four times as many add one, so that work follows
    the square root of the disc's content. Blocks of at most ``leaf`` places have
    the first level only.
    """
    by = list(by)
    tx, ty = target_xy
    sx, sy = source_xy
    ids = list(dict.fromkeys([*by, *target_id]))
    t = targets.select(*ids, F.col(tx).cast("double").alias("_tx"), F.col(ty).cast("double").alias("_ty")).dropna(
        subset=[*by, "_tx", "_ty"])
    # First cells are a little wider than the radius, so that 3 x 3 of them hold the disc and its margin.
    base = radius * 1.001 or 1.0
    corner = [*by, "_bx", "_by"]
    parts = [c for i in range(len(values)) for c in (f"_s{i}", f"_n{i}")] + ["_n"]
    sums = [x for i, v in enumerate(values) for x in
            (F.sum(v).alias(f"_s{i}"), F.count(v).alias(f"_n{i}"))]
    places = (
        sources.dropna(subset=[*by, sx, sy])
        .groupBy(*by, F.col(sx).cast("double").alias("_x"), F.col(sy).cast("double").alias("_y"))
        .agg(*sums, F.count(F.lit(1)).alias("_n"))
        .withColumns({"_bx": F.floor(F.col("_x") / F.lit(base)), "_by": F.floor(F.col("_y") / F.lit(base))})
    )
    places = cut_lineage(places)  # counted by block, summed by cell and tested one by one

    around = F.explode(F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"))
                                 for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("_d")

    def neighbours(cells: DataFrame, *kept: str) -> DataFrame:
        return cells.select(*corner, *kept, around).withColumns(
            {"_bx": F.col("_bx") + F.col("_d.x"), "_by": F.col("_by") + F.col("_d.y")}).drop("_d")

    # Levels of a block by the places in it, and for each first cell the levels of the blocks it belongs to: at most nine.
    counted = places.groupBy(*corner).agg(F.count(F.lit(1)).alias("_held"))
    blocks = neighbours(counted, "_held").groupBy(*corner).agg(F.sum("_held").alias("_held")).select(
        *corner, F.greatest(F.lit(0), F.least(F.lit(MAX_BITS), F.floor(
            F.log(F.col("_held") / F.lit(float(leaf))) / F.lit(math.log(4.0))))).cast("int").alias("_depth"))
    used = neighbours(blocks, "_depth").groupBy(*corner).agg(F.collect_set("_depth").alias("_used"))

    keyed = places.join(used, corner, "inner")
    cell = {f"_c{a}": F.floor(F.col(f"_{a}") / (F.lit(base) / F.pow(F.lit(2.0), "_level"))) for a in "xy"}
    key = [*by, "_level", "_cx", "_cy"]
    inner = (
        keyed.withColumn("_level", F.explode(F.sequence(F.lit(0), F.array_max("_used")))).withColumns(cell)
        .groupBy(*key).agg(*[F.sum(c).alias(c) for c in parts])
        .select(*key, F.lit(False).alias("_edge"), *parts,
                F.lit(None).cast("double").alias("_x"), F.lit(None).cast("double").alias("_y"))
    )
    edge = keyed.withColumn("_level", F.explode("_used")).withColumns(cell).select(
        *key, F.lit(True).alias("_edge"), *parts, "_x", "_y")
    at = stored(_with_depth(t, blocks, corner, base))
    cover, cells = _cover_by_size(at, ids, radius, base, inner.unionByName(edge), [*key, "_edge"])
    found = (
        cover.join(cells, [*key, "_edge"], "inner")
        .where(~F.col("_edge") | (planar_m("_tx", "_ty", "_x", "_y") <= F.lit(radius)))
    )
    # Every target also brings a row of its own without sums: what has nothing else is alone.
    nothing = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in parts]
    disc = cut_lineage(
        found.select(*ids, "_tx", "_ty", *parts).unionByName(t.select(*ids, "_tx", "_ty", *nothing))
        .groupBy(*ids).agg(F.min("_tx").alias("_tx"), F.min("_ty").alias("_ty"),
                           *[F.sum(c).alias(c) for c in parts]))  # a row per target, used twice
    means = [F.try_divide(F.col(f"_s{i}"), F.col(f"_n{i}")).alias(v + suffix)
             for i, v in enumerate(values)]
    full = disc.where("_n > 0").select(*ids, *means, F.col("_n").cast("long").alias(count))
    fallback = nearest_site(
        disc.where("_n is null").select(*ids, "_tx", "_ty"), sources, query_id=target_id, query_uv=("_tx", "_ty"),
        site_uv=(sx, sy), payload=list(values), tie=list(source_id), by=by, metric="planar", distance="_d")
    fallback = fallback.select(
        *ids, *[F.col(v).cast("double").alias(v + suffix) for v in values],
        F.lit(1).cast("long").alias(count))
    return full.unionByName(fallback)


def _with_depth(targets: DataFrame, blocks: DataFrame, corner: list[str], base: float) -> DataFrame:
    """Targets with the number of levels of their block; 0 where no source is near."""
    at = targets.withColumns({"_bx": F.floor(F.col("_tx") / F.lit(base)), "_by": F.floor(F.col("_ty") / F.lit(base))})
    return at.join(blocks, corner, "left").withColumn("_depth", F.coalesce("_depth", F.lit(0)))


def _cover_by_size(at: DataFrame, ids: list[str], radius: float, base: float, cells: DataFrame,
                   key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The two sides of the join of discs and summed cells, over so many tasks that each unfolds and
    joins about ``COVER_ROWS`` cells of discs, in however few tasks the targets were read.

    A disc has some 20 * 2 ** depth cells. The size of a side that unfolds is not seen before it
    has unfolded, so it is never left to be broadcast: the summed cells are, when they are
    few, and both sides meet by a sorted shuffle else.
    """
    rows = at.agg(F.sum(F.pow(F.lit(2.0), "_depth") * F.lit(20.0))).first()[0] or 0.0
    tasks = max(1, math.ceil(rows / COVER_ROWS))
    cover = _disc_cells(at.repartition(tasks, *ids), [*ids, "_tx", "_ty"], radius, base)
    cells = stored(cells)
    if fits(cells):
        return cover, F.broadcast(cells)
    return cover.repartition(tasks, *key).hint("merge"), cells.repartition(tasks, *key)


def _disc_cells(targets: DataFrame, kept: list[str], radius: float, base: float) -> DataFrame:
    """``kept``, _level, _cx, _cy, _edge: the cells that make up each target's disc.

    A row of cells meets the disc in one range, and lies inside it in a smaller
    one. Of the cells inside, those whose parent is inside too are left out; of
    the cells that the edge crosses, only those of the last level (_edge) stay. A
    parent's bounds come from the same numbers as its children's, doubled exactly,
    so that each place is in one cell of the cover.
    """
    rows = targets.withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_depth"))))
    side = F.lit(base) / F.pow(F.lit(2.0), "_level")
    # Rounding of coordinates and cell edges stays inside the margin.
    margin = F.least(F.lit(radius * SLACK) + (F.abs("_tx") + F.abs("_ty") + F.lit(radius)) * F.lit(1e-14),
                     F.lit(base * 5e-4))
    rows = rows.withColumns({"_side": side, "_in": F.lit(radius) - margin, "_out": F.lit(radius) + margin})
    rows = rows.withColumn("_cy", F.explode(F.sequence(
        F.floor((F.col("_ty") - F.col("_out")) / F.col("_side")), F.floor((F.col("_ty") + F.col("_out")) / F.col("_side")))))

    def half(reach: str, gap: Column) -> Column:
        """Half the disc's width at ``gap`` from its middle, NULL beyond."""
        return F.when(gap <= F.col(reach), F.sqrt(F.col(reach) * F.col(reach) - gap * gap))

    def inside(level_up: int) -> tuple[Column, Column]:
        row, size = F.shiftright("_cy", level_up), F.col("_side") * F.lit(float(1 << level_up))
        y0, y1 = row * size, (row + F.lit(1)) * size
        h = half("_in", F.greatest(F.abs(F.col("_ty") - y0), F.abs(y1 - F.col("_ty"))))
        return F.ceil((F.col("_tx") - h) / size), F.floor((F.col("_tx") + h) / size) - F.lit(1)

    y0, y1 = F.col("_cy") * F.col("_side"), (F.col("_cy") + F.lit(1)) * F.col("_side")
    touch = half("_out", F.greatest(y0 - F.col("_ty"), F.col("_ty") - y1, F.lit(0.0)))
    bounds = {"_a": inside(0)[0], "_b": inside(0)[1], "_pa": inside(1)[0], "_pb": inside(1)[1],
              "_lo": F.floor((F.col("_tx") - touch) / F.col("_side")),
              "_hi": F.floor((F.col("_tx") + touch) / F.col("_side"))}
    rows = rows.withColumns(bounds)
    any_in, parent_in = F.col("_a") <= F.col("_b"), (F.col("_level") > 0) & (F.col("_pa") <= F.col("_pb"))
    any_in, parent_in = F.coalesce(any_in, F.lit(False)), F.coalesce(parent_in, F.lit(False))
    last = F.col("_level") == F.col("_depth")

    def span(when: Column, lo: Column, hi: Column, edge: bool) -> Column:
        return F.when(when & (lo <= hi), F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(edge).alias("edge")))

    one = F.lit(1)
    spans = F.array(
        span(any_in & ~parent_in, F.col("_a"), F.col("_b"), False),
        span(any_in & parent_in, F.col("_a"), F.col("_pa") * 2 - one, False),
        span(any_in & parent_in, F.col("_pb") * 2 + 2, F.col("_b"), False),
        span(last & ~any_in, F.col("_lo"), F.col("_hi"), True),
        span(last & any_in, F.col("_lo"), F.col("_a") - one, True),
        span(last & any_in, F.col("_b") + one, F.col("_hi"), True))
    return (rows.select(*kept, "_level", "_cy", F.explode(F.array_compact(spans)).alias("_span"))
            .select(*kept, "_level", "_cy", F.col("_span.edge").alias("_edge"),
                    F.explode(F.sequence("_span.lo", "_span.hi")).alias("_cx")))
