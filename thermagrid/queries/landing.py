"""Sources and sinks: whole given tables written to a fresh folder and read back."""

import json

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_path
from ..sources import runs, sinks, tables
from .base import long, query, r, table


@query("csv_by_name", """
SELECT c_custkey, c_nationkey::BIGINT AS nation, round(c_acctbal, 6) AS balance,
       CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END AS segment
FROM customer
""")
def csv_by_name(spark, sf):
    """Two files with other column orders, one lacking a column."""
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    even, odd = fresh_path(spark), fresh_path(spark)
    sinks.write_csv(c.where("c_nationkey % 2 = 0"), even)
    sinks.write_csv(c.where("c_nationkey % 2 = 1"), odd, ["c_acctbal", "c_nationkey", "c_custkey"], gzip=True)
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_nationkey", T.LongType()),
                           T.StructField("c_acctbal", T.DoubleType()), T.StructField("c_mktsegment", T.StringType())])
    out = tables.read_csv(spark, [even, odd], schema)
    return out.select("c_custkey", F.col("c_nationkey").alias("nation"), r("c_acctbal").alias("balance"),
                      F.col("c_mktsegment").alias("segment"))


@query("area_files_round_trip", """
SELECT 'n' || o.n AS area_id, nation.n_name AS area_name, o.c_custkey, o.balance
FROM (SELECT c_nationkey AS n, c_custkey, round(c_acctbal, 6) AS balance FROM customer) o
JOIN nation ON nation.n_nationkey = o.n
""")
def area_files_round_trip(spark, sf):
    """One folder of CSV files for each area, read back with the area's name."""
    areas = table(spark, sf, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey")).alias("area_id"), F.col("n_name").alias("area_name"))
    c = table(spark, sf, "customer").select(
        F.concat(F.lit("n"), F.col("c_nationkey")).alias("area"), "c_custkey", "c_acctbal")
    path = fresh_path(spark)
    sinks.write_per_area(c, path, "area")
    rows = tables.lineage_rows(spark, path, areas.withColumn("area_id", F.concat(F.lit("area="), F.col("area_id"))))
    return rows.select(F.regexp_replace("area_id", "^area=", "").alias("area_id"), "area_name",
                       long("c_custkey").alias("c_custkey"), r(F.col("c_acctbal").try_cast("double")).alias("balance"))


@query("table_round_trip", """
SELECT event_type, event_id, user_id, round(value, 6) AS value FROM events
""")
def table_round_trip(spark, sf):
    """A partitioned table, clustered by a value that many rows share, in two appends."""
    e = table(spark, sf, "events", "event_id", "user_id", "event_type", "value")
    path = fresh_path(spark)
    sinks.write_table(e.where("event_id % 2 = 0"), path, ["event_type"], ["event_id"])
    sinks.write_table(e.where("event_id % 2 <> 0"), path, ["event_type"], ["event_id"], mode="append")
    return tables.read_parquet(spark, path).select("event_type", "event_id", "user_id", r("value").alias("value"))


@query("normalised_csv", """
SELECT s_suppkey, n_name AS nation FROM supplier JOIN nation ON n_nationkey = s_nationkey
""")
def normalised_csv(spark, sf):
    """An output rewritten in place, twice; its backup keeps the first columns."""
    path, backup = fresh_path(spark), fresh_path(spark)
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("s_nationkey"),
                                               F.col("n_name").alias("nation"))
    sinks.write_csv(table(spark, sf, "supplier", "s_suppkey", "s_nationkey", "s_acctbal"), path)
    sinks.normalise_output(spark, path, backup, lambda d: d.drop("s_acctbal"))
    sinks.normalise_output(spark, path, backup, lambda d: d.join(nation, "s_nationkey").select("s_suppkey", "nation"))
    kept = spark.read.option("header", True).csv(backup)
    return tables.read_csv(spark, path).join(kept.select("s_suppkey"), "s_suppkey").select(
        long("s_suppkey").alias("s_suppkey"), "nation")


@query("error_counts", """
SELECT event_type AS source, count(*) AS errors FROM events GROUP BY event_type
UNION ALL SELECT 'absent', 0
""")
def error_counts(spark, sf):
    """Rows of one error file for each event type; messages hold line breaks."""
    e = table(spark, sf, "events").select("event_type", F.concat_ws("\n", F.col("event_id"), F.lit("failed")).alias("message"))
    folder = fresh_path(spark)
    e.repartition("event_type").write.partitionBy("event_type").option("header", True).csv(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder)
    names = files.select("path", F.regexp_extract("path", "event_type=([^/]+)", 1).alias("source")).collect()
    counted = tables.error_rows(spark, {x.path: x.path for x in names} | {"absent": f"{folder}/absent.csv"})
    source = F.coalesce(F.nullif(F.regexp_extract("source", "event_type=([^/]+)", 1), F.lit("")), F.col("source"))
    return counted.select(source.alias("source"), "errors").groupBy("source").agg(F.sum("errors").alias("errors"))


@query("split_files", """
SELECT split, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM (
  SELECT CASE o_orderkey % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' WHEN 2 THEN 'train' END AS split, o_totalprice
  FROM orders) WHERE split IS NOT NULL GROUP BY split
""")
def split_files(spark, sf):
    """Rows by split folder; rows kept only for prediction are left out."""
    k = F.col("o_orderkey") % 4
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.when(k == 0, "test").when(k == 1, "validation")
                                          .when(k == 2, "train").otherwise("prediction").alias("split"))
    path = fresh_path(spark)
    sinks.write_splits(o, path, ["o_orderkey", "o_totalprice"])
    back = spark.read.option("header", True).csv(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"),
                                     r(F.sum(F.col("o_totalprice").try_cast("decimal(18,2)")).cast("double"), 2).alias("price"))


@query("missing_keys", """
SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0
""")
def missing_keys(spark, sf):
    """Keys not landed yet, after two landings."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey")
    path = fresh_path(spark)
    sinks.append_table(o.where("o_orderkey % 3 = 1"), path)
    sinks.append_table(o.where("o_orderkey % 3 = 2"), path)
    return sinks.missing_partitions(spark, o, path, "o_orderkey").select("o_orderkey")


@query("landing_in_batches", """
SELECT o_orderdate::DATE AS date, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1
""")
def landing_in_batches(spark, sf):
    """Dates landed in three runs. The second breaks off between rows and keys and is run again; the third
    is offered dates that are there already."""
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_totalprice").withColumn("date", F.to_date("o_orderdate"))
    third = F.pmod(F.xxhash64("date"), F.lit(3))
    to = sinks.Landing(spark, fresh_path(spark), ["date"])
    to.land(o.where(third == 0), "one")
    to.write_rows(to.missing(o.where(third == 1)), "two")  # broken off here: nothing of it counts
    to = sinks.Landing(spark, to.path, ["date"])
    to.land(o.where(third <= 1), "two")
    to.land(o, "three")
    to.land(o, "three")
    return to.read().groupBy("date").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2).alias("price"))


@query("node_csv", """
WITH n AS (SELECT c_custkey::VARCHAR AS node_id, 37.0 + (c_custkey // 40) / 100.0::DOUBLE AS latitude, -6.0 + (c_custkey % 40) / 100.0::DOUBLE AS longitude,
  c_custkey // 40 AS "row", c_custkey % 40 AS col FROM customer)
SELECT node_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, "row", col,
  round("row" / greatest(max("row") OVER (), 1)::DOUBLE, 9) AS row_norm, round(col / greatest(max(col) OVER (), 1)::DOUBLE, 9) AS col_norm FROM n
""")
def node_csv(spark, sf):
    """Node files under either name of the coordinates, every second node twice; a later copy lies elsewhere."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer", "c_custkey").select(
        k.alias("node_id"), (F.lit(37.0) + F.floor(k / 40) / F.lit(100.0)).alias("lat"), (F.lit(-6.0) + k % 40 / F.lit(100.0)).alias("lon"),
        F.floor(k / 40).alias("row"), (k % 40).alias("col"))
    one, two = fresh_path(spark), fresh_path(spark)
    sinks.write_csv(c, one)
    copies = c.where("node_id % 2 = 0").select("node_id", F.lit(1.0).alias("longitude"), F.lit(2.0).alias("latitude"), (F.col("row") + 1000).alias("row"), "col")
    sinks.write_csv(copies, two)
    other = tables.read_csv(spark, two).withColumnsRenamed({"latitude": "lat", "longitude": "lon"})
    nodes = tables.node_table(tables.read_csv(spark, one).unionByName(other, allowMissingColumns=True))
    return nodes.select("node_id", r("latitude").alias("latitude"), r("longitude").alias("longitude"), long("row").alias("row"),
                        long("col").alias("col"), r("row_norm", 9).alias("row_norm"), r("col_norm", 9).alias("col_norm"))


@query("fine_scene_rows", """
SELECT l_orderkey::VARCHAR || '-' || l_linenumber AS node_id, 'S' || l_suppkey AS scene_id, epoch_us(l_shipdate) + l_linenumber * 3600000000 AS acquired_us,
  l_partkey % 900 AS SR_B1, 0 AS technical FROM lineitem
""")
def fine_scene_rows(spark, sf):
    """Scene samples as they are landed, without their technical columns."""
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate")
    raw = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("node_id"), F.concat(F.lit("S"), "l_suppkey").alias("scene_id"),
                    (F.unix_millis(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * 3_600_000).alias("time_start"),
                    F.to_date("l_shipdate").alias("date"), (F.col("l_partkey") % 900).alias("SR_B1"), F.lit("{}").alias(".geo"), F.lit("x").alias("geo"))
    path = fresh_path(spark)
    sinks.write_table(raw.withColumnRenamed(".geo", "dot_geo"), path)
    out = tables.fine_scenes(tables.read_parquet(spark, path).withColumnRenamed("dot_geo", ".geo"), ["SR_B1"])
    technical = sum(c in (".geo", "geo") for c in out.columns)
    return out.select("node_id", "scene_id", F.unix_micros("acquisition_dt_utc").alias("acquired_us"), long("SR_B1").alias("SR_B1"),
                      F.lit(technical).cast("int").alias("technical"))


@query("json_report", """
SELECT o_orderpriority AS label, count(*) AS rows, count(DISTINCT o_orderdate::DATE) AS dates, min(o_orderdate)::DATE::VARCHAR AS first_date,
  count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders GROUP BY 1
""")
def json_report(spark, sf):
    """A nested report of the table written as JSON and read back."""
    o = table(spark, sf, "orders", "o_orderpriority", "o_orderdate", "o_orderstatus").withColumn("date", F.to_date("o_orderdate"))
    parts = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("date").alias("dates"), F.min("date").alias("first_date"),
                                             F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    report = parts.agg(F.collect_list(F.struct("*")).alias("parts"), F.sum("rows").alias("rows")).select(  # five priorities
        F.struct(F.lit("complete").alias("status"), "rows").alias("quality"), "parts")
    path = fresh_path(spark)
    sinks.write_report(report, path)
    back = spark.read.json(path).where("quality.status = 'complete'").select(F.inline("parts"))
    return back.select(F.col("o_orderpriority").alias("label"), long("rows").alias("rows"), long("dates").alias("dates"), "first_date",
                       long("finished").alias("finished"))


@query("sorted_csv", """
SELECT count(*) AS rows, 0::BIGINT AS out_of_order, (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_totalprice, o_orderkey LIMIT 1) AS first_key,
  (SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_totalprice DESC, o_orderkey DESC LIMIT 1) AS last_key FROM orders
""")
def sorted_csv(spark, sf):
    """The order of the final files: line by line inside a file, and from file to file."""
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate", "o_totalprice")
    path = fresh_path(spark)
    sinks.write_csv(o, path, order=[F.col("o_orderdate").desc(), "o_totalprice", "o_orderkey"])
    order = F.struct((-F.unix_micros(F.col("o_orderdate").try_cast("timestamp"))).alias("a"), F.col("o_totalprice").try_cast("double").alias("b"),
                     F.col("o_orderkey").try_cast("long").alias("c"))
    rows = spark.read.option("header", True).csv(path).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), order.alias("at"), F.col("o_orderkey").try_cast("long").alias("k"))
    inside = Window.partitionBy("file", "block").orderBy("line")  # a file's lines keep their order in a split
    parts = rows.withColumn("before", F.lag("at").over(inside)).groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") > F.col("at")).alias("bad"), F.min("at").alias("lo"), F.max("at").alias("hi"),
        F.min_by("k", "at").alias("k0"), F.max_by("k", "at").alias("k1"))
    across = Window.orderBy("file", "block")  # one row for each file
    joined = parts.withColumn("late", F.coalesce((F.lag("hi").over(across) > F.col("lo")).cast("long"), F.lit(0)))
    place = F.struct("file", "block")
    return joined.agg(F.sum("n").alias("rows"), F.sum(F.col("bad") + F.col("late")).alias("out_of_order"),
                      F.min_by("k0", place).alias("first_key"), F.max_by("k1", place).alias("last_key"))


def put_file(spark, path, text, millis):
    """A small file with a given time of change."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(target)
    out.write(bytearray(text.encode()))
    out.close()
    fs.setTimes(target, millis, -1)


@query("latest_runs", """
WITH n AS (SELECT n_nationkey AS k, 1700000000 + (n_nationkey * 7 % 25) * 60 AS t FROM nation)
SELECT 'dataset' AS kind, (SELECT 'run_' || arg_max(k, (t, 'run_' || k)) FROM n WHERE k % 2 = 0 AND k % 3 <> 0) AS run, (SELECT max(t) FROM n WHERE k % 2 = 0 AND k % 3 <> 0)::BIGINT AS changed
UNION ALL SELECT 'areas', (SELECT 'run_' || arg_max(k, (t, 'run_' || k)) FROM n WHERE k % 3 < 2 AND k % 4 > 0 AND k % 5 > 0), (SELECT max(t) FROM n WHERE k % 3 < 2 AND k % 4 > 0 AND k % 5 > 0)::BIGINT
""")
def latest_runs(spark, sf):
    """A run folder for each nation: of some the purpose is another, the quality file lacks, or no area is done."""
    root = fresh_path(spark)
    for (k,) in table(spark, sf, "nation", "n_nationkey").collect():  # 25 nations
        millis = 1000 * (1_700_000_000 + (k * 7 % 25) * 60)
        at, both = f"{root}/runs/run_{k}/data_downloads", f"{root}/runs/run_{k}/combined"
        put_file(spark, f"{at}/{runs.DATASET_FILES['table']}", "node_id\n", millis)
        purpose = "lst_downscaling" if k % 2 == 0 else "general_download"
        put_file(spark, f"{at}/{runs.DATASET_FILES['metadata']}", json.dumps({"request": {"dataset_purpose": purpose}}), millis)
        if k % 3:
            put_file(spark, f"{at}/{runs.DATASET_FILES['quality']}", "{}", millis)
        status = ("complete", "partial", "error")[k % 3]
        put_file(spark, f"{both}/{runs.AREA_FILES['quality']}", json.dumps({"status": status, "areas_completed": k % 4}), millis)
        put_file(spark, f"{both}/{runs.AREA_FILES['metadata']}", "{}", millis)
        if k % 5:
            put_file(spark, f"{both}/{runs.AREA_FILES['table']}", "node_id\n", millis)
    found = runs.latest_dataset(spark, root).withColumn("kind", F.lit("dataset")).unionByName(
        runs.latest_area_run(spark, root).withColumn("kind", F.lit("areas")))
    return found.select("kind", F.regexp_extract("path", r"/(run_\d+)", 1).alias("run"), F.unix_seconds("modified").alias("changed"))
