"""Registry of queries over the given tables, each with its SQL twin.

The given tables are not satellite tables, so a query derives the domain shape
it needs (positions, temperatures, dates) from their whole rows, with the same
plain arithmetic in Spark and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

# Multipliers that spread consecutive keys evenly over the unit square.
SPREAD_A = 0.7548776662466927
SPREAD_B = 0.5698402909980532


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a UTC instant instead of the zone-less one."""
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def day(c: str) -> Column:
    return F.to_date(F.col(c))


def r(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def r_many(c: Column | str, digits: int = 6) -> Column:
    """``r`` for results of very many rows, by the arithmetic of the SQL's round (away from zero at a half):
    ``F.round`` takes a double through decimal text, which costs more than the rest of a row."""
    c = F.col(c) if isinstance(c, str) else c
    scale = F.lit(10.0 ** digits)
    return F.signum(c) * F.floor(F.abs(c) * scale + F.lit(0.5)) / scale + F.lit(0.0)


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def frac(k: Column | str, m: float) -> Column:
    v = (F.col(k) if isinstance(k, str) else k).cast("double") * F.lit(m)
    return v - F.floor(v)


def lat_of(k: Column | str) -> Column:
    return F.lit(37.0) + frac(k, SPREAD_A)


def lon_of(k: Column | str) -> Column:
    return F.lit(-6.0) + frac(k, SPREAD_B)


# The same in SQL.

def s_frac(k: str, m: float) -> str:
    return f"(({k})::DOUBLE * {m!r} - floor(({k})::DOUBLE * {m!r}))"


def s_lat(k: str) -> str:
    return f"(37.0::DOUBLE + {s_frac(k, SPREAD_A)})"


def s_lon(k: str) -> str:
    return f"(-6.0::DOUBLE + {s_frac(k, SPREAD_B)})"


def s_r(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE)"


def s_haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = (f"(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * "
         f"cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2))")
    return f"(2 * 6371008.8::DOUBLE * atan2(sqrt({h}), sqrt(greatest(0.0, 1 - {h}))))"


def s_scaled(lat: str, lon: str, lat2: str, lon2: str) -> str:
    return (f"(pow(({lat}) - ({lat2}), 2) + "
            f"pow((({lon}) - ({lon2})) * cos(radians({lat})), 2))")


def s_list(items: Iterable[str]) -> str:
    return ", ".join(items)
