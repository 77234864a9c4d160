import glob
import os

import pytest

import __spark_entry__ as entry
from thermagrid import schemas
from thermagrid.plans.coarse import with_status
from thermagrid.streaming.incremental import land_new_files

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not glob.glob(SMALL + "/*.parquet"), reason="given tables are absent")


@needs_data
def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.columns == ["nodo_id", "date", "lst_landsat", "lst_sentinel_3", "hour_landsat", "hour_sentinel"]
    assert out.count() > 0


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@needs_data
@pytest.mark.parametrize("name", ["nearest_date_tolerance", "daily_rain_rolling", "quality_cascade", "grid_edges",
                                  "scope_by_area", "landing_in_batches"])
def test_queries_match_their_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for path in glob.glob(SMALL + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cur = con.execute(entry.oracle_sql()[name])
    heads = [d[0] for d in cur.description]
    want = sorted(str(tuple(str(r[heads.index(h)]) for h in sorted(heads))) for r in cur.fetchall())
    got = sorted(str(tuple(str(r[h]) for h in sorted(heads))) for r in entry.queries()[name](spark, SMALL).collect())
    assert got == want


def test_land_new_files_sees_each_file_once(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def land(lst):
        row = (0, 0, lst, 1.0, 0.1, 0.0, 0.0, 0.0, 0.0, 1.0)
        spark.createDataFrame([row], schemas.PIXELS).coalesce(1).write.mode("append").parquet(source)
        land_new_files(spark, source, schemas.PIXELS, target,
                       lambda df: with_status(df).where("status = 'valid'"), checkpoint=state)
    land(300.0)
    land(301.0)
    land(999.0)
    assert sorted(r.LST for r in spark.read.parquet(target).collect()) == [300.0, 301.0]
