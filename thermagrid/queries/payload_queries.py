"""Queries of the JSON payload readers and the text operators."""

from pyspark.sql import functions as F

from ..functions import text
from ..functions.calendar import micros
from ..operators.catalogue import alias_table, canonical_names, names_by_category, variable_cards
from ..operators.fusion import content_key
from ..sources import payloads
from .base import day, events, long, query, r, s_r, table


@query("props_json", f"""
SELECT event_id, user_id, {s_r("coalesce((props->>'$.k')::DOUBLE, 0)")} AS k, (props->>'$.missing') IS NULL AS absent FROM events
""")
def props_json(spark, sf):
    e = events(spark, sf).withColumn("p", F.from_json("props", "map<string,string>"))
    from ..functions.core import number
    value = number(F.try_element_at("p", F.lit("k")))
    return e.select("event_id", "user_id", r(F.coalesce(value, F.lit(0.0))).alias("k"),
                    F.try_element_at("p", F.lit("missing")).isNull().alias("absent"))


@query("catalogue_json", f"""
SELECT event_id, event_id::VARCHAR AS "Id", CASE WHEN event_type = 'view' THEN event_id::VARCHAR ELSE 'S3_' || event_type END AS "Name",
  epoch_us(date_trunc('minute', ts)) AS acquired_us, ts::DATE AS date, hour(ts)::BIGINT AS hour, {s_r("CASE WHEN event_type <> 'click' THEN value END")} AS cloud_cover
FROM events WHERE event_type <> 'error'
""")
def catalogue_json(spark, sf):
    e = events(spark, sf)
    stamp = F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'"))
    item = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.map_from_arrays(
            F.array(F.lit("datetime"), F.lit("sentinel3:product_id"), F.lit("eo:cloud_cover")),
            F.array(F.coalesce(stamp, F.lit("not a time")),
                    F.when(F.col("event_type") != "view", F.concat(F.lit("S3_"), "event_type")),
                    F.when(F.col("event_type") != "click", F.col("value").cast("string"))))
        .alias("properties"))
    nameless = F.struct(F.lit(" ").alias("id"), F.map_from_arrays(
        F.array(F.lit("datetime")), F.array(F.lit("2024-01-01T00:00Z"))).alias("properties"))
    docs = e.select("event_id", F.to_json(F.struct(F.array(item, nameless).alias("features"))).alias("doc"))
    out = payloads.catalogue_items(docs, "doc", ["event_id"])
    return out.select("event_id", "Id", "Name", micros("acquisition_dt_utc").alias("acquired_us"),
                      "date", long("hour").alias("hour"), r("cloud_cover").alias("cloud_cover"))


@query("statistics_json", f"""
SELECT event_id, ts::DATE AS date, {s_r('270 + value')} AS "LST", {s_r('value / 10', 7)} AS "LST_uncertainty", {s_r('user_id')} AS "CONFIDENCE"
FROM events WHERE event_type <> 'signup'
""")
def statistics_json(spark, sf):
    def band(value):
        return F.struct(F.struct(value.cast("string").alias("mean")).alias("stats"))

    e = events(spark, sf)
    lst = F.when(F.col("event_type") != "signup", F.lit(270) + F.col("value")).otherwise(F.lit(float("nan")))
    bands = F.map_from_arrays(
        F.array(F.lit("LST"), F.lit("LST_uncertainty"), F.lit("CONFIDENCE")),
        F.array(band(lst), band(F.col("value") / 10), band(F.col("user_id"))))
    item = F.struct(
        F.struct(F.date_format("ts", "yyyy-MM-dd'T'00:00:00'Z'").alias("from")).alias("interval"),
        F.struct(F.struct(bands.alias("bands")).alias("data")).alias("outputs"))
    docs = e.select("event_id", F.to_json(F.struct(F.array(item).alias("data"))).alias("doc"))
    out = payloads.statistics_rows(docs, "doc", ["event_id"])
    return out.select("event_id", "date", r("LST").alias("LST"),
                      r("LST_uncertainty", 7).alias("LST_uncertainty"),
                      r("CONFIDENCE").alias("CONFIDENCE"))


@query("headed_rows_json", f"""
SELECT epoch_us(date_trunc('hour', ts)) AS t_us, {s_r('avg(value)', 8)} AS t2m, {s_r("avg(CASE WHEN event_type <> 'view' THEN value / 100 END)", 10)} AS tp
FROM events GROUP BY 1
""")
def headed_rows_json(spark, sf):
    from ..operators.series import regional_mean
    e = events(spark, sf)
    cells = F.array(
        F.array(*[F.lit(c) for c in ("id", "time", "tp", "t2m")]),
        F.array(F.col("event_id").cast("string"),
                F.unix_millis(F.date_trunc("hour", "ts")).cast("string"),
                F.when(F.col("event_type") != "view", (F.col("value") / 100).cast("string")),
                F.col("value").cast("string")))
    docs = e.select(F.to_json(cells).alias("doc"))
    rows = payloads.headed_rows(docs, "doc", ["t2m", "tp"])
    out = regional_mean(rows, "era5_dt_utc", ["t2m", "tp"])
    return out.select(micros("era5_dt_utc").alias("t_us"), r("t2m", 8).alias("t2m"),
                      r("tp", 10).alias("tp"))


def _answers(spark, sf):
    """One geocoder answer per part: three candidates made of its own words."""
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")

    def candidate(name, kind, place, importance):
        return F.struct(
            name.alias("display_name"), (F.lit(37) + F.col("p_size") / 100).cast("string").alias("lat"),
            (F.lit(-6) + F.col("p_size") / 100).cast("string").alias("lon"),
            F.col("p_partkey").cast("string").alias("osm_id"), place.alias("type"),
            importance.alias("importance"),
            F.array(*[F.lit(v) for v in ("36.0", "38.0", "-7.0", "-5.0")]).alias("boundingbox"),
            F.struct(kind.alias("type")).alias("geojson"))

    answer = F.array(
        candidate(F.col("p_name"), F.lit("Point"), F.lit("city"),
                  (F.col("p_retailprice") / 2000).cast("string")),
        candidate(F.concat_ws(", ", F.col("p_type"), F.col("p_name")), F.when(F.col("p_size") > 25, F.lit("Polygon")).otherwise(F.lit("Point")),
                  F.lit("suburb"), F.lit(None).cast("string")),
        candidate(F.col("p_brand"), F.lit("MultiPolygon"), F.lit("quarter"), F.lit("0.9")))
    return p.select("p_partkey", F.concat_ws(", ", "p_name", "p_brand").alias("query"),
                    F.to_json(answer).alias("doc"))


CANDIDATE_SQL = f"""
WITH c AS (
  SELECT p_partkey, p_size, p_name || ', ' || p_brand AS query, unnest([0, 1, 2]) AS position,
    unnest([p_name, p_type || ', ' || p_name, p_brand]) AS name,
    unnest(['Point', CASE WHEN p_size > 25 THEN 'Polygon' ELSE 'Point' END, 'MultiPolygon']) AS kind,
    unnest(['city', 'suburb', 'quarter']) AS place, unnest([p_retailprice / 2000, 0, 0.9]) AS importance FROM part)
"""


@query("geocoder_json", CANDIDATE_SQL + f"""
SELECT p_partkey, position::BIGINT AS position, name AS display_name, {s_r('37 + p_size / 100')} AS latitude, {s_r('-6 + p_size / 100')} AS longitude,
  p_partkey AS osm_id, place AS place_type, {s_r('importance')} AS importance, -7.0::DOUBLE AS west, 38.0::DOUBLE AS north, kind AS geometry_type FROM c
""")
def geocoder_json(spark, sf):
    out = payloads.geocoder_candidates(_answers(spark, sf), "doc", ["p_partkey"])
    return out.select("p_partkey", long("position").alias("position"), "display_name",
                      r("latitude").alias("latitude"), r("longitude").alias("longitude"), "osm_id",
                      "place_type", r("importance").alias("importance"),
                      F.col("bounding_box")[0].alias("west"), F.col("bounding_box")[3].alias("north"),
                      "geometry_type")


@query("candidate_rank", CANDIDATE_SQL + """
, w AS (SELECT DISTINCT p_partkey, unnest(string_split_regex(lower(p_name || ', ' || p_brand), '[,\\s]+')) AS word FROM part),
s AS (SELECT c.p_partkey, c.position, any_value(c.name) AS name, any_value(c.importance) AS importance,
  count(w.word) FILTER (length(w.word) > 2 AND contains(lower(c.name), w.word)) + any_value(CASE WHEN kind IN ('Polygon', 'MultiPolygon') THEN 2 ELSE 0 END)
   + any_value(CASE WHEN place IN ('neighbourhood', 'suburb', 'quarter', 'residential') THEN 1 ELSE 0 END) AS score
  FROM c JOIN w ON w.p_partkey = c.p_partkey GROUP BY c.p_partkey, c.position)
SELECT p_partkey, name AS display_name, score::BIGINT AS score FROM s
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, importance DESC, position) = 1
""")
def candidate_rank(spark, sf):
    rows = payloads.geocoder_candidates(_answers(spark, sf), "doc", ["p_partkey", "query"])
    out = payloads.best_candidate(rows, "query", ["p_partkey"])
    return out.select("p_partkey", "display_name", long("score").alias("score"))


@query("mean_reference_points", f"""
SELECT n_regionkey::BIGINT AS region, {s_r('avg(37 + n_nationkey / 10)')} AS latitude, {s_r('avg(-6 - n_nationkey / 10)')} AS longitude, count(*) AS references_n
FROM nation GROUP BY 1
""")
def mean_reference_points(spark, sf):
    p = table(spark, sf, "nation", "n_nationkey", "n_regionkey").select(
        long("n_regionkey").alias("region"), (F.lit(37) + F.col("n_nationkey") / 10).alias("latitude"),
        (F.lit(-6) - F.col("n_nationkey") / 10).alias("longitude"))
    out = payloads.mean_reference_point(p, ["region"])
    return out.select("region", r("latitude").alias("latitude"), r("longitude").alias("longitude"),
                      F.col("references").alias("references_n"))


@query("feature_rows_json", f"""
SELECT c_custkey, c_custkey::VARCHAR AS node_id, {s_r('c_acctbal')} AS value, {s_r("CASE WHEN c_mktsegment = 'BUILDING' THEN 1.5 ELSE -5.9 END")} AS longitude,
 {s_r("CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE 37.4 END")} AS latitude FROM customer
""")
def feature_rows_json(spark, sf):
    c = table(spark, sf, "customer", "c_custkey", "c_acctbal", "c_mktsegment")
    properties = F.map_from_arrays(
        F.array(F.lit("node_id"), F.lit("value"), F.lit("longitude")),
        F.array(F.col("c_custkey").cast("string"), F.col("c_acctbal").cast("string"),
                F.when(F.col("c_mktsegment") == "BUILDING", F.lit("1.5"))))
    geometry = F.struct(
        F.when(F.col("c_mktsegment") == "MACHINERY", "None").otherwise("Point").alias("type"),
        F.array(F.lit(-5.9), F.lit(37.4)).alias("coordinates"))
    # Without a point there is no coordinate to fall back on.
    geometry = geometry.withField("coordinates", F.when(
        F.col("c_mktsegment") != "MACHINERY", F.array(F.lit(-5.9), F.lit(37.4))))
    properties = F.when(F.col("c_mktsegment") == "MACHINERY", F.map_concat(
        F.map_filter(properties, lambda k, v: k != "longitude"),
        F.create_map(F.lit("longitude"), F.lit("-5.9")))).otherwise(properties)
    docs = c.select("c_custkey", F.to_json(F.struct(F.array(F.struct(
        properties.alias("properties"), geometry.alias("geometry"))).alias("features"))).alias("doc"))
    out = payloads.feature_rows(docs, "doc", {"node_id": "string", "value": "double",
                                              "longitude": "double", "latitude": "double"},
                                ["c_custkey"])
    return out.select("c_custkey", "node_id", *[r(c).alias(c) for c in (
        "value", "longitude", "latitude")])


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def s_fold(expr: str) -> str:
    """The database's own accent stripping; the given texts hold accented letters only."""
    return rf"regexp_replace(strip_accents({expr}), '[^\x00-\x7F]', '', 'g')"


def s_normal(expr: str) -> str:
    space = r"[\s\x0b\x1c-\x1f]"
    return (f"regexp_replace(lower(regexp_replace({s_fold(expr)}, '^{space}+|{space}+$', '', 'g')), "
            f"'{space}+', ' ', 'g')")


@query("normalize_text", f"SELECT doc_id, md5({s_normal('text')}) AS digest, length({s_normal('text')}) AS length FROM documents")
def normalize_text(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", text.normalize_text("text").alias("t"))
    return d.select("doc_id", F.md5("t").alias("digest"), long(F.length("t")).alias("length"))


# Aliases in the languages of the corpus.
CORPUS_ALIASES = {
    "the": "definite", "der": "definite", "die": "definite", "das": "definite", "les": "definite",
    "of the": "genitive", "de la": "genitive", "du": "genitive", "und": "joining", "and": "joining",
    "et": "joining", "que": "relative", "qui": "relative", "that": "relative", "ist": "copula",
    "are": "copula", "zu": "direction", "pour": "direction", "for": "direction",
    "in the": "location", "dans": "location", "sur": "location", "on": "location", "la": "article",
    "el": "article", "una": "article", "une": "article", "los": "article", "por": "direction",
}


def _tag_sql() -> str:
    names = ", ".join(f"({_q(a)}, {_q(n)})" for a, n in CORPUS_ALIASES.items())
    return f"""
WITH d AS (SELECT doc_id, {s_normal('text')} AS t FROM documents), a(alias, name) AS (VALUES {names}),
h AS (SELECT doc_id, name, min(instr(t, alias)) AS pos FROM d, a
  WHERE contains(t, alias) AND regexp_matches(t, '(^|[^a-z0-9_])' || alias || '($|[^a-z0-9_])') GROUP BY doc_id, name)
SELECT d.doc_id, coalesce(string_agg(h.name, ',' ORDER BY h.pos, h.name), '') AS tags FROM d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id
"""


@query("alias_tagging", _tag_sql())
def alias_tagging(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", F.array_join(text.tag_terms("text", CORPUS_ALIASES), ",").alias("tags"))


@query("request_moves", """
SELECT conv_id, turn::BIGINT AS turn, CASE WHEN conv_id % 4 = 0 THEN 'north' END AS direction,
       CASE conv_id % 4 WHEN 1 THEN 2.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE END AS scale_factor,
       CASE WHEN conv_id % 4 = 2 THEN 'Peñón ' || conv_id || CASE WHEN turn % 2 = 1 THEN ', sevilla' ELSE '' END END AS place
FROM conversations
""")
def request_moves(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn")
    k = F.col("conv_id") % 4
    request = (F.when(k == 0, "Mueve la zona 300 m al norte").when(k == 1, "Hazla el doble de grande")
               .when(k == 3, "Reduce a la mitad el tamaño")
               .otherwise(F.concat(F.when(F.col("turn") % 2 == 1, "En Sevilla, ").otherwise(""), F.lit("el barrio de Peñón "),
                                   F.col("conv_id").cast("string"), F.lit("."))))
    slots = text.request_slots(request)
    return c.select("conv_id", long("turn").alias("turn"), *[slots[n].alias(n) for n in ("direction", "scale_factor", "place")])


# Names as users write them and the catalogue's name; unknown names have none.
WRITTEN_NAMES = [
    ("SVF", "sky_view_factor"), ("Elevación", "elevation"), (" DEM ", "elevation"), ("edificios", "buildings"),
    ("Cañón urbano", "aspect_ratio"), ("cañon urbano", "aspect_ratio"), ("Temperatura de rocío", "dewpoint_temperature"),
    ("tair", "air_temperature"), ("Emisividad superficial", "surface_emissivity"), ("calles", "roads"),
    ("quality_flag_1km", "sentinel3_quality"), ("Espesor óptico de aerosoles", "aerosol_optical_thickness"),
    ("índice de vegetación normalizado", "NDVI"), ("no such name", None),
]


@query("canonical_names", "WITH w(k, written, canonical) AS (VALUES " + ", ".join(
    f"({k}, {_q(w)}, {_q(c) if c else 'NULL'})" for k, (w, c) in enumerate(WRITTEN_NAMES)) + f""")
SELECT p_partkey, written, canonical FROM part JOIN w ON p_partkey % {len(WRITTEN_NAMES)} = k
""")
def canonical_names_query(spark, sf):
    names = F.array(*[F.lit(w) for w, _ in WRITTEN_NAMES])
    p = table(spark, sf, "part", "p_partkey").withColumn(
        "written", F.element_at(names, (F.col("p_partkey") % len(WRITTEN_NAMES) + 1).cast("int")))
    out = canonical_names(p, "written", alias_table(spark, variable_cards()))
    return out.select("p_partkey", "written", "canonical")


@query("slot_extract", f"""
WITH d AS (SELECT conv_id, turn, lower({s_fold("'Zona ' || text || ' entre mayo y octubre de 20' || lpad((conv_id % 30)::VARCHAR, 2, '0') || ' a ' || turn || '0,5 m, ' || conv_id || ' km2, mueve 2 km'")}) AS t FROM conversations)
SELECT conv_id, turn::BIGINT AS turn, regexp_extract(t, '\\b(20\\d{{2}})\\b', 1) || '-05-01' AS start_date, regexp_extract(t, '\\b(20\\d{{2}})\\b', 1) || '-10-31' AS end_date,
 {s_r("replace(regexp_extract(t, '(?:a|resolucion(?: de)?)\\s*(\\d+(?:[.,]\\d+)?)\\s*(?:m|metros?)\\b', 1), ',', '.')::DOUBLE")} AS resolution_m,
 {s_r("replace(regexp_extract(t, '(\\d+(?:[.,]\\d+)?)\\s*(?:km\\s*(?:\\^?2|²)|kilometros?\\s+cuadrados?)', 1), ',', '.')::DOUBLE")} AS area_km2,
 {s_r("replace(regexp_extract(t, '(\\d+(?:[.,]\\d+)?)\\s*(km|m|metros?|kilometros?)', 1), ',', '.')::DOUBLE * CASE WHEN regexp_extract(t, '(\\d+(?:[.,]\\d+)?)\\s*(km|m|metros?|kilometros?)', 2) LIKE 'k%' THEN 1000 ELSE 1 END")} AS distance_m,
 contains(t, 'anade') OR contains(t, 'agrega') OR contains(t, 'incluye') OR contains(t, 'tambien') AS adds FROM d
""")
def slot_extract(spark, sf):
    c = table(spark, sf, "conversations", "conv_id", "turn", "text")
    request = F.concat(F.lit("Zona "), "text", F.lit(" entre mayo y octubre de 20"),
                       F.lpad((F.col("conv_id") % 30).cast("string"), 2, "0"), F.lit(" a "),
                       F.col("turn").cast("string"), F.lit("0,5 m, "),
                       F.col("conv_id").cast("string"), F.lit(" km2, mueve 2 km"))
    slots = text.request_slots(request)
    return c.select("conv_id", long("turn").alias("turn"), *[
        (r(slots[n]) if n in ("resolution_m", "area_km2", "distance_m") else slots[n]).alias(n)
        for n in ("start_date", "end_date", "resolution_m", "area_km2", "distance_m", "adds")])


def _class_sql() -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains(t, {_q(m)})" for m in markers) + f" THEN {_q(code)}"
                     for code, markers in text.FAILURE_RULES)
    return f"CASE {whens} ELSE 'UNCLASSIFIED_ERROR' END"


@query("error_classes", f"""
WITH e AS (SELECT lower(event_type || ' HTTP ' || (400 + event_id % 40)::VARCHAR || CASE WHEN user_id % 7 = 0 THEN ' Connection timed out' WHEN user_id % 7 = 1 THEN ' No space left on device'
  WHEN user_id % 7 = 2 THEN ' Kernel died' ELSE '' END) AS t FROM events UNION ALL SELECT lower(text) FROM conversations),
c AS (SELECT {_class_sql()} AS code FROM e)
SELECT code, count(*) AS n FROM c GROUP BY code
""")
def error_classes(spark, sf):
    e = events(spark, sf)
    u = F.col("user_id") % 7
    message = F.concat("event_type", F.lit(" HTTP "), (F.lit(400) + F.col("event_id") % 40).cast("string"),
                       F.when(u == 0, " Connection timed out").when(u == 1, " No space left on device")
                       .when(u == 2, " Kernel died").otherwise(""))
    lines = e.select(message.alias("text")).unionByName(
        table(spark, sf, "conversations", "text"))
    return lines.groupBy(text.failure_class("text").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("batch_diagnosis", """
WITH m AS (SELECT user_id, CASE WHEN value > 120 THEN '429' WHEN value > 90 THEN 'TIMEOUT' WHEN value > 80 THEN '403' WHEN value > 70 THEN '503' WHEN event_type = 'click' AND value > 60 THEN '404' ELSE '200' END AS status,
  CASE WHEN value < 0.5 THEN 'Invalid envelope CRS' ELSE '' END AS excerpt FROM events)
SELECT user_id, CASE WHEN bool_or(contains(excerpt, 'Invalid envelope CRS')) THEN 'configuration' WHEN bool_or(status = '429') THEN 'rate_limit' WHEN bool_or(status = 'TIMEOUT') THEN 'timeout'
  WHEN bool_or(status IN ('401', '403')) THEN 'authorization' WHEN bool_or(starts_with(status, '5')) THEN 'server' WHEN bool_and(status = '200') THEN 'operational' ELSE 'mixed' END AS diagnosis, count(*) AS calls
FROM m GROUP BY user_id
""")
def batch_diagnosis(spark, sf):
    from ..operators.diagnosis import diagnose_batches
    v = F.col("value")
    m = events(spark, sf).select(
        "user_id", F.when(v > 120, "429").when(v > 90, "TIMEOUT").when(v > 80, "403").when(v > 70, "503")
        .when((F.col("event_type") == "click") & (v > 60), "404").otherwise("200").alias("status"),
        F.when(v < 0.5, "Invalid envelope CRS").otherwise("").alias("error_excerpt"))
    return diagnose_batches(m, ["user_id"])


@query("place_query_cleanup", """
WITH q AS (SELECT p_partkey, ' el barrio de ' || p_name || ' , en ' || p_type || ' ,, ' AS q FROM part)
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(q, ' .,'), '^(?:el\\s+)?barrio\\s+de\\s+', '', 'gi'), ',\\s*en\\s+', ', ', 'gi'),
  '\\s+en\\s+([^,]+)$', ', \\1', 'gi'), '\\s*,\\s*', ', ', 'g'), '(?:,\\s*){2,}', ', ', 'g'), ' ,') AS place FROM q
""")
def place_query_cleanup(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_type")
    q = F.concat(F.lit(" el barrio de "), "p_name", F.lit(" , en "), "p_type", F.lit(" ,, "))
    return p.select("p_partkey", text.place_query(q).alias("place"))


@query("content_keys", """
SELECT c_custkey, substr(sha1('{"c_nationkey":' || c_nationkey || ',"c_mktsegment":"' || c_mktsegment || '"}'), 1, 16) AS content_key FROM customer
""")
def content_keys(spark, sf):
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    return c.select("c_custkey", content_key(["c_nationkey", "c_mktsegment"]).alias("content_key"))


@query("catalogue_listing", """
SELECT p_type AS category, count(DISTINCT p_brand) AS names, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS members FROM part WHERE p_size <= 25 GROUP BY 1
""")
def catalogue_listing(spark, sf):
    cards = table(spark, sf, "part", "p_type", "p_brand", "p_size").select(
        F.col("p_brand").alias("name"), F.col("p_type").alias("category"),
        F.when(F.col("p_size") <= 25, "available").otherwise("planned").alias("availability"))
    out = names_by_category(cards)
    return out.select("category", F.size("names").cast("long").alias("names"),
                      F.array_join("names", ",").alias("members"))


@query("stable_area_ids", """
SELECT p_partkey, CASE WHEN p_size <= 25 THEN 'roi_' || substr(sha1('{"p_size":' || p_size || '}'), 1, 10)
  ELSE trim(regexp_replace(p_name || ' (' || p_brand || ')', '[^A-Za-z0-9_-]+', '_', 'g'), '_') END AS area_id FROM part
""")
def stable_area_ids(spark, sf):
    from ..operators.fusion import stable_area_id
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_size")
    written = F.when(F.col("p_size") > 25, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")))
    return p.select("p_partkey", stable_area_id(written, ["p_size"]).alias("area_id"))
