"""Nested JSON payloads to rows. Each takes a text column and keeps key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.calendar import millis_to_time, parse_time
from ..functions.core import number
from ..functions.geo import point
from ..session import dealt_evenly

#: Search answers that one task unfolds, about.
ANSWERS_AT_ONCE = 20_000

# Band order of the coarse product.
COARSE_BANDS = ["LST", "LST_uncertainty", "NDVI", "CLOUD", "BAYES", "POINTING", "CONFIDENCE"]
POLYGON_TYPES = ("Polygon", "MultiPolygon")
# End of fixed values.


def catalogue_items(df: DataFrame, text: str, keys: Sequence[str] = ()) -> DataFrame:
    """Feature collections to products; items without id or readable time go."""
    items = df.select(*keys, F.explode(
        F.from_json(F.col(text), schemas.CATALOGUE_JSON)["features"]).alias("f"))
    p = F.col("f.properties")
    taken = parse_time(F.try_element_at(p, F.lit("datetime")))
    item_id = F.trim(F.coalesce(F.col("f.id"), F.lit("")))
    rows = items.select(
        *keys, item_id.alias("Id"),
        F.coalesce(F.nullif(F.try_element_at(p, F.lit("sentinel3:product_id")), F.lit("")),
                   item_id).alias("Name"),
        taken.alias("acquisition_dt_utc"), F.to_date(taken).alias("date"),
        F.hour(taken).alias("hour"),
        number(F.try_element_at(p, F.lit("eo:cloud_cover"))).alias("cloud_cover"))
    return rows.where(F.col("acquisition_dt_utc").isNotNull() & (F.col("Id") != ""))


def statistics_rows(df: DataFrame, text: str, keys: Sequence[str] = (),
                    bands: Sequence[str] = COARSE_BANDS) -> DataFrame:
    """Daily cell statistics to one row per interval with the band means; rows
    without a temperature go."""
    items = df.select(*keys, F.explode(
        F.from_json(F.col(text), schemas.STATISTICS_JSON)["data"]).alias("d"))
    b = F.col("d.outputs.data.bands")
    rows = items.select(
        *keys, F.to_date(parse_time(F.col("d.interval.from"))).alias("date"),
        *[number(F.try_element_at(b, F.lit(name))["stats"]["mean"]).alias(name)
          for name in bands])
    return rows.where(F.col(bands[0]).isNotNull())


def headed_rows(df: DataFrame, text: str, fields: Sequence[str], keys: Sequence[str] = (),
                time: str = "time") -> DataFrame:
    """Array of arrays whose first one is the header, to typed rows."""
    parsed = df.select(*keys, F.from_json(F.col(text), schemas.HEADED_ROWS_JSON).alias("r"))
    body = parsed.where(F.size("r") > 1).select(
        *keys, F.element_at("r", 1).alias("h"),
        F.explode(F.slice("r", F.lit(2), F.size("r") - 1)).alias("v"))

    def value(name: str) -> Column:
        return F.try_element_at("v", F.nullif(F.array_position("h", name), F.lit(0)).cast("int"))

    return body.select(*keys, millis_to_time(value(time)).alias("era5_dt_utc"),
                       *[number(value(f)).alias(f) for f in fields])


def geocoder_candidates(df: DataFrame, text: str, keys: Sequence[str] = ()) -> DataFrame:
    """Search answers to candidates; box order becomes west, south, east, north."""
    items = dealt_evenly(df, df.count(), ANSWERS_AT_ONCE).select(*keys, F.posexplode(
        F.from_json(F.col(text), schemas.GEOCODER_JSON)).alias("position", "c"))
    box = F.transform("c.boundingbox", lambda v: v.try_cast("double"))
    return items.select(
        *keys, "position", F.col("c.display_name").alias("display_name"),
        number("c.lat").alias("latitude"), number("c.lon").alias("longitude"),
        F.col("c.osm_type").alias("osm_type"), F.col("c.osm_id").try_cast("long").alias("osm_id"),
        F.col("c.category").alias("category"), F.col("c.type").alias("place_type"),
        F.coalesce(number("c.importance"), F.lit(0.0)).alias("importance"),
        F.when(F.size("c.boundingbox") == 4, F.array(box[2], box[0], box[3], box[1]))
        .alias("bounding_box"),
        F.col("c.geojson.type").alias("geometry_type"))


def feature_rows(df: DataFrame, text: str, properties: dict[str, str],
                 keys: Sequence[str] = ()) -> DataFrame:
    """Feature collections to property columns (name -> type); a point's
    coordinates fill in missing longitude and latitude."""
    items = df.select(*keys, F.explode(
        F.from_json(F.col(text), schemas.FEATURES_JSON)["features"]).alias("f"))
    is_point = F.col("f.geometry.type") == "Point"
    out = []
    for name, kind in properties.items():
        c = F.try_element_at(F.col("f.properties"), F.lit(name)).try_cast(kind)
        if name in ("longitude", "latitude"):
            axis = F.lit(1 if name == "longitude" else 2)
            c = F.coalesce(c, F.when(is_point, F.try_element_at(
                F.col("f.geometry.coordinates"), axis)))
        out.append(c.alias(name))
    return items.select(*keys, *out)


def polygon_ring(text: str | Column) -> Column:
    """Outer ring of a polygon geometry text as an array of points."""
    text = F.col(text) if isinstance(text, str) else text
    geometry = F.from_json(text, schemas.EDITED_SQUARE_JSON)
    return F.transform(F.try_element_at(geometry["coordinates"], F.lit(1)),
                       lambda c: point(c[0], c[1]))


def best_candidate(candidates: DataFrame, query: str, keys: Sequence[str]) -> DataFrame:
    """Per query: most query words in the name, plus 2 for an area geometry and
    1 for a neighbourhood-like place; ties by importance, then first listed."""
    words = F.filter(F.array_distinct(F.split(F.regexp_replace(
        F.lower(F.col(query)), "[,\\s]+", " "), " ")), lambda w: F.length(w) > 2)
    name = F.lower(F.col("display_name"))
    hits = F.size(F.filter(words, lambda w: F.contains(name, w)))
    score = (hits + F.when(F.col("geometry_type").isin(*POLYGON_TYPES), 2).otherwise(0)
             + F.when(F.col("place_type").isin("neighbourhood", "suburb", "quarter", "residential"),
                      1).otherwise(0))
    scored = candidates.withColumn("score", score)
    order = F.struct(F.col("score"), F.col("importance"), (-F.col("position")).alias("p"))
    row = F.struct(*scored.columns)
    return scored.groupBy(*keys).agg(F.max_by(row, order).alias("b")).select("b.*")


def mean_reference_point(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    return points.groupBy(*keys).agg(F.avg("latitude").alias("latitude"),
                                     F.avg("longitude").alias("longitude"),
                                     F.count(F.lit(1)).alias("references"))
