"""The variable catalogue as a small table: listing and alias look-up."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spectral, weather
from ..functions.text import normalize_text
from .lookups import map_values

# Names and aliases of the core variables.
CORE_CARDS = {
    "LST": ("Temperatura y calidad", {"landsat": ["LST_K"], "sentinel3": ["LST_1km"]},
            ["temperatura superficial", "temperatura de superficie", "land surface temperature"]),
    "NDVI": ("Vegetación y superficie", None, ["indice de vegetacion"]),
    "NDBI": ("Vegetación y superficie", None, ["indice de edificacion"]),
    "ALBEDO": ("Vegetación y superficie", None, ["reflectividad superficial"]),
}
WEATHER_ALIASES = {
    "air_temperature": ["temperatura del aire", "tair"],
    "dewpoint_temperature": ["punto de rocio", "dewpoint"],
    "relative_humidity": ["humedad relativa", "rh"],
    "solar_radiation": ["radiacion solar", "rsol"],
    "wind_speed": ["velocidad del viento", "viento"],
    "wind_direction": ["direccion del viento"],
    "rain_1d": ["lluvia diaria"],
    "rain_3d": ["lluvia acumulada", "precipitacion"],
    "is_rainy": ["indicador lluvia"],
    "skin_temperature": ["temperatura de piel"],
    "surface_pressure": ["presion superficial"],
    "snow_cover": ["cobertura de nieve"],
    "snow_depth": ["espesor de nieve"],
    "vapour_pressure_deficit": ["vpd", "deficit de presion de vapor"],
}
WEATHER_DISPLAY = {
    "air_temperature": "Temperatura del aire",
    "dewpoint_temperature": "Temperatura de rocío",
    "relative_humidity": "Humedad relativa",
    "solar_radiation": "Radiación solar descendente",
    "thermal_radiation_down": "Radiación térmica descendente",
    "wind_u10": "Componente este-oeste del viento",
    "wind_v10": "Componente norte-sur del viento",
    "wind_speed": "Velocidad del viento",
    "wind_direction": "Dirección del viento",
    "rain_1d": "Precipitación diaria",
    "rain_3d": "Precipitación acumulada 3 días",
    "rain_3d_log": "Precipitación acumulada 3 días logarítmica",
    "is_rainy": "Indicador de lluvia reciente",
    "skin_temperature": "Temperatura de piel ERA5-Land",
    "surface_pressure": "Presión superficial",
    "snow_cover": "Cobertura de nieve",
    "snow_depth": "Espesor de nieve",
    "vapour_pressure_deficit": "Déficit de presión de vapor",
}
INDEX_DISPLAY = {
    "LST": "Temperatura superficial terrestre",
    "NDVI": "Índice de vegetación normalizado",
    "NDBI": "Índice normalizado de edificación",
    "ALBEDO": "Albedo de banda ancha aproximado",
    "NDWI": "Índice de agua NDWI",
    "MNDWI": "Índice de agua modificado",
    "NDMI": "Índice de humedad normalizado",
    "EVI": "Índice de vegetación mejorado",
    "SAVI": "Índice de vegetación ajustado al suelo",
    "BSI": "Índice de suelo desnudo",
    "urban_index": "Índice urbano espectral",
}
# name: (display name, output column, further aliases)
THERMAL_CARDS = {
    "surface_emissivity": ("Emisividad superficial", "surface_emissivity", []),
    "emissivity_uncertainty": ("Incertidumbre de emisividad", "emissivity_uncertainty", []),
    "atmospheric_transmittance": ("Transmitancia atmosférica", "atmospheric_transmittance", []),
    "cloud_distance": ("Distancia a nubes", "cloud_distance_km", []),
    "LST_uncertainty": ("Incertidumbre de LST Landsat", "LST_uncertainty_K", []),
}
ATMOSPHERE_CARDS = {
    "aerosol_optical_thickness": ("Espesor óptico de aerosoles", "AOT", []),
    "water_vapour": ("Vapor de agua Sentinel-2", "water_vapour_cm", []),
}
COARSE_CARDS = {
    "sentinel3_lst_uncertainty": ("Incertidumbre LST Sentinel-3", "LST_uncertainty_1km", []),
    "sentinel3_ndvi": ("NDVI auxiliar Sentinel-3", "NDVI_S3", []),
    "sentinel3_quality": ("Indicador de calidad Sentinel-3", "quality_flag_1km", []),
}
COARSE_NOT_EXPOSED = {
    "sentinel3_vegetation_fraction": ("Fracción vegetal Sentinel-3", "vegetation_fraction_1km", []),
    "sentinel3_tcwv": ("Vapor de agua total Sentinel-3", "TCWV_1km", []),
    "sentinel3_biome": ("Bioma Sentinel-3", "biome_class_1km", []),
    "sentinel3_uncertainty_random": ("Incertidumbre SLSTR aleatoria", "LST_uncertainty_random_1km", []),
    "sentinel3_uncertainty_loct": ("Incertidumbre SLSTR calibración local", "LST_uncertainty_locT_1km", []),
    "sentinel3_uncertainty_locatm": ("Incertidumbre SLSTR atmosférica local", "LST_uncertainty_locATM_1km", []),
    "sentinel3_uncertainty_locsf": ("Incertidumbre SLSTR emisividad superficial", "LST_uncertainty_locSF_1km", []),
    "sentinel3_uncertainty_locgeo": ("Incertidumbre SLSTR geolocalización", "LST_uncertainty_locGEO_1km", []),
    "sentinel3_uncertainty_sys": ("Incertidumbre SLSTR sistemática", "LST_uncertainty_sys_1km", []),
}
STATIC_CARDS = {
    "elevation": ("Elevación", "DEM", ["elevacion", "dem", "altitud"]),
    "buildings": ("Presencia de edificios", "has_buildings", ["edificios", "buildings", "morfologia urbana"]),
    "building_height": ("Altura media de edificios", "building_height_m", ["altura de edificios", "building height"]),
    "building_footprint": ("Superficie edificada", "bld_footprint_m2", ["huella de edificios", "superficie edificada"]),
    "aspect_ratio": ("Relación altura-anchura urbana", "aspect_ratio", ["aspect ratio", "aspect_ratio", "cañon urbano"]),
    "sky_view_factor": ("Factor de visión del cielo", "sky_view_factor",
                        ["sky view factor", "svf", "factor de vision del cielo"]),
}
PLANNED_CARDS = {
    "building_coverage_ratio": "Fracción de suelo edificada",
    "building_count": "Número de edificios",
    "building_height_std": "Variabilidad de alturas",
    "building_height_p90": "Percentil 90 de altura",
    "building_volume_density": "Densidad de volumen construido",
    "facade_density": "Densidad de fachada",
    "floor_area_ratio": "Floor Area Ratio",
    "shadow_fraction": "Fracción de sombra",
    "solar_exposure_fraction": "Fracción de exposición solar",
    "frontal_area_index": "Índice de área frontal",
    "urban_roughness_proxy": "Rugosidad urbana",
    "street_orientation": "Orientación dominante de calles",
    "road_length_density": "Densidad de red viaria",
    "road_area_fraction": "Fracción ocupada por calzadas",
    "major_road_distance": "Distancia a vía principal",
    "intersection_density": "Densidad de intersecciones",
    "mean_street_width": "Anchura media de calle",
    "paved_road_fraction": "Fracción viaria pavimentada",
    "green_space_fraction": "Fracción de zonas verdes OSM",
    "residential_fraction": "Fracción residencial",
    "commercial_fraction": "Fracción comercial",
    "industrial_fraction": "Fracción industrial",
    "roads": "Red viaria",
}
ROAD_ALIASES = ["carreteras", "calles", "roads", "red viaria"]
# End of fixed values.


def variable_cards() -> dict[str, dict]:
    """Name -> category, output columns per stream, aliases. Built from the
    field tables: each name also answers to itself with spaces."""
    cards: dict[str, dict] = {}

    def add(name, category, outputs, aliases, availability="available"):
        own = {name.lower(), name.lower().replace("_", " ")}
        shown = INDEX_DISPLAY.get(name) or WEATHER_DISPLAY.get(name)
        own |= {shown.lower()} if shown else set()
        cards[name] = {"category": category, "output_columns": outputs,
                       "aliases": sorted(own | set(aliases)), "availability": availability}

    def family(table, category, streams, availability="available"):
        for name, (shown, column, aliases) in table.items():
            add(name, category, {stream: [column] for stream in streams},
                [shown.lower(), column.lower(), *aliases], availability)

    for name, (category, outputs, aliases) in CORE_CARDS.items():
        add(name, category, outputs or {"landsat": [name], "sentinel3": [name]}, aliases)
    for name in spectral.INDEX_NAMES:
        if name not in cards:
            add(name, "Vegetación y superficie", {"landsat": [name], "sentinel3": [name]}, [])
    for band in spectral.COVARIATE_BANDS:
        streams = {"sentinel3": [f"SR_{band}"]}
        if band in spectral.FINE_BANDS:
            streams["landsat"] = [f"SR_{band}"]
        add(f"reflectance_{band}", "Bandas espectrales", streams, [f"sr_{band}"])
    for name, column in weather.OUTPUT_NAMES.items():
        add(name, "Meteorología", {"landsat": [column], "sentinel3": [column]},
            [column.lower(), *WEATHER_ALIASES.get(name, [])])
    family(THERMAL_CARDS, "Temperatura y calidad", ["landsat"])
    family(ATMOSPHERE_CARDS, "Atmósfera satelital", ["sentinel3"])
    family(COARSE_CARDS, "Sentinel-3 y calidad", ["sentinel3"])
    family(COARSE_NOT_EXPOSED, "Sentinel-3 y calidad", ["sentinel3"], "not_exposed_by_process_api")
    family(STATIC_CARDS, "Morfología urbana", ["landsat", "sentinel3"])
    for name, shown in PLANNED_CARDS.items():
        add(name, "Urbanas planificadas", {}, [shown.lower(), *(ROAD_ALIASES if name == "roads" else [])], "planned")
    return cards


def plain_alias(alias: str) -> str:
    folded = unicodedata.normalize("NFKD", alias).encode("ascii", "ignore").decode()
    return re.sub(r"\s+", " ", folded.strip().lower())


def alias_map(cards: dict[str, dict], include_planned: bool = True) -> dict[str, str]:
    return {plain_alias(a): name for name, card in cards.items()
            if include_planned or card["availability"] == "available" for a in card["aliases"]}


def alias_table(spark: SparkSession, cards: dict[str, dict]) -> DataFrame:
    return spark.createDataFrame(list(alias_map(cards).items()), "alias string, canonical string")


def canonical_names(df: DataFrame, column: str, aliases: DataFrame,
                    out: str = "canonical") -> DataFrame:
    """Look-up of a written name; unknown names give NULL."""
    keyed = df.withColumn("_plain", normalize_text(column))
    return map_values(keyed, "_plain", aliases, "alias", "canonical", out).drop("_plain")


def names_by_category(cards: DataFrame, include_planned: bool = False) -> DataFrame:
    kept = cards if include_planned else cards.where(F.col("availability") == "available")
    return kept.groupBy("category").agg(F.sort_array(F.collect_set("name")).alias("names"))
