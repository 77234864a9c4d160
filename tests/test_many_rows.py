"""Steps that tables of many rows go through: exact results, and no shuffle of the rows."""

import numpy as np
from pyspark.sql import functions as F

from thermagrid.models import translation
from thermagrid.operators import near_space, ranking
from thermagrid.operators.ranking import fold_medians
from thermagrid.session import stored


def test_medians_of_odd_values_equal_sorted_ones(spark):
    """Values far from their mean, zeros of both signs, infinities, gaps, ties and groups of other levels."""
    rng = np.random.default_rng(7)
    columns = {"far": rng.lognormal(0, 9, 400), "near": 1e6 + rng.normal(0, 1e-6, 400), "ties": rng.integers(0, 3, 400) / 10,
               "zeros": np.where(rng.random(400) < 0.5, -0.0, 0.0), "ends": rng.choice([-np.inf, -1.0, 2.0, np.inf], 400)}
    area, fold = rng.integers(0, 3, 400), rng.integers(1, 4, 400)
    columns["near"] = columns["near"] * 1000.0 ** area
    gap = rng.random(400) < 0.2
    rows = [(f"a{area[i]}", int(fold[i]), *[None if gap[i] else float(c[i]) for c in columns.values()]) for i in range(400)]
    df = spark.createDataFrame(rows, "area string, fold int, " + ", ".join(f"{c} double" for c in columns)).repartition(5)
    for by, ranges in (([], 64), (["area"], 2)):
        for r in fold_medians(df, list(columns), by, "fold", ranges=ranges).collect():
            assert sorted(e.fold for e in r.medians) == [1, 2, 3]
            for e in r.medians:
                kept = ~gap & (fold != e.fold) & ((area == int(r.area[1:])) if by else True)
                assert e.medians == [float(np.median(c[kept])) for c in columns.values()]


def test_counts_of_bins_are_bounded_in_a_task(spark):
    """A task passes its counts on when there are many; what it holds does not grow with its rows."""
    df = spark.range(30_000).coalesce(1).select(F.lit(1).alias("k"), (F.rand(3) * F.exp(F.rand(4) * 40)).alias("_d0"))
    got = ranking._binned(df, ["k"], 1, 12, most=500).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("bins")).first()
    assert got.n == 30_000 and got.bins > 2_000


def test_pixel_means_day_sizes_and_models_join_without_a_shuffle_of_the_rows(spark):
    """Small sides are written and counted first; before, every join of them shuffled all rows."""
    rows = spark.range(3000).select(
        F.concat(F.lit("n"), "id").alias("node_id"), (F.col("id") % 3).alias("area_id"), (F.col("id") % 4).alias("sentinel3_pixel_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 15).cast("int")).alias("date"), (F.rand(1) * 9 + 290).alias("LST_K"),
        (F.col("id") % 15 + 290.0).alias("LST_1km"), *[F.rand(i + 2).alias(c) for i, c in enumerate(translation.SPATIAL_SOURCES)])
    rows = stored(rows)
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
            spark.conf.set(k, v)
        for by in ([], ["area_id"]):
            tagged = translation.prepare_folds(translation.translation_features(rows, True), folds=3, by=by, written=True)
            bundle = translation.fit_bundle(tagged, "linear+ridge", by=by, fold="fold")
            out = translation.predict_bundle(bundle, tagged)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan, [line for line in plan.splitlines() if "Join" in line]
            assert out.where("LST_predicted_K IS NULL").count() == 0
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_discs_and_leaves_join_by_size(spark, monkeypatch):
    """Discs unfold over as many tasks as their cells need, and neither their cells nor the arrays of
    sites are broadcast by an estimate made before they grew; the means stay those of all pairs."""
    rng = np.random.default_rng(11)
    at, places = rng.random((90, 2)) * 100, rng.random((2500, 2)) * 70
    t = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "t long, x double, y double").coalesce(1)
    n = spark.createDataFrame([(i, *map(float, p), float(i % 17)) for i, p in enumerate(places)], "n long, x double, y double, v double")
    how = dict(target_id=["t"], target_xy=("x", "y"), source_xy=("x", "y"), source_id=["n"], values=["v"], radius=9.0)

    def found():
        return {r.t: (round(r.v_mean, 9), r.n_sources) for r in near_space.radius_mean(t, n, **how).collect()}

    want = {}
    for i, p in enumerate(at):
        d = np.hypot(*(places - p).T)
        near = np.flatnonzero(d <= 9.0) if (d <= 9.0).any() else np.array([d.argmin()])
        want[i] = (round(float(np.mean(near % 17)), 9), len(near))
    assert found() == want
    monkeypatch.setattr(near_space, "COVER_ROWS", 200)
    monkeypatch.setattr(near_space, "fits", lambda *_: False)
    joins, sides = [], near_space._cover_by_size
    monkeypatch.setattr(near_space, "_cover_by_size", lambda *a: joins.append(sides(*a)) or joins[-1])
    assert found() == want
    cover, cells = joins[0]
    assert cover.rdd.getNumPartitions() > 8
    plan = cover.join(cells, ["_level", "_cx", "_cy", "_edge"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
