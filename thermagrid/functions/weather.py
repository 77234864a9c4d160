"""Hourly weather fields: names, unit conversions and derived quantities."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import clip, col

# Request name, archive field, short name, output column and
# conversion class of the weather fields. "flux" is energy per hour, "depth"
# is metres of water, "celsius" is kelvin.
SINGLE_FIELDS = [
    ("air_temperature", "2m_temperature", "t2m", "Tair_C", "celsius"),
    ("dewpoint_temperature", "2m_dewpoint_temperature", "d2m", "dewpoint_C", "celsius"),
    ("solar_radiation", "surface_solar_radiation_downwards", "ssrd", "Rsol_Wm2", "flux"),
    ("thermal_radiation_down", "surface_thermal_radiation_downwards", "strd", "Rthermal_Wm2", "flux"),
    ("wind_u10", "10m_u_component_of_wind", "u10", "wind_u10", "copy"),
    ("wind_v10", "10m_v_component_of_wind", "v10", "wind_v10", "copy"),
    ("skin_temperature", "skin_temperature", "skt", "skin_temperature_C", "celsius"),
    ("surface_pressure", "surface_pressure", "sp", "surface_pressure_hPa", "hecto"),
    ("snow_cover", "snow_cover", "snowc", "snow_cover_pct", "fraction"),
    ("snow_depth", "snow_depth", "sd", "snow_depth_m", "copy"),
    ("soil_temperature_level_1", "soil_temperature_level_1", "stl1", "soil_temperature_l1", "celsius"),
    ("soil_temperature_level_2", "soil_temperature_level_2", "stl2", "soil_temperature_l2", "celsius"),
    ("soil_temperature_level_3", "soil_temperature_level_3", "stl3", "soil_temperature_l3", "celsius"),
    ("soil_temperature_level_4", "soil_temperature_level_4", "stl4", "soil_temperature_l4", "celsius"),
    ("soil_moisture_level_1", "volumetric_soil_water_layer_1", "swvl1", "soil_moisture_l1", "copy"),
    ("soil_moisture_level_2", "volumetric_soil_water_layer_2", "swvl2", "soil_moisture_l2", "copy"),
    ("soil_moisture_level_3", "volumetric_soil_water_layer_3", "swvl3", "soil_moisture_l3", "copy"),
    ("soil_moisture_level_4", "volumetric_soil_water_layer_4", "swvl4", "soil_moisture_l4", "copy"),
    ("lake_bottom_temperature", "lake_bottom_temperature", "lblt", "lake_bottom_temperature_C", "celsius"),
    ("lake_ice_depth", "lake_ice_depth", "licd", "lake_ice_depth_m", "copy"),
    ("lake_ice_temperature", "lake_ice_temperature", "lict", "lake_ice_temperature_C", "celsius"),
    ("lake_mix_layer_depth", "lake_mix_layer_depth", "lmld", "lake_mix_layer_depth_m", "copy"),
    ("lake_mix_layer_temperature", "lake_mix_layer_temperature", "lmlt", "lake_mix_layer_temperature_C", "celsius"),
    ("lake_shape_factor", "lake_shape_factor", "lshf", "lake_shape_factor", "copy"),
    ("lake_total_layer_temperature", "lake_total_layer_temperature", "llt", "lake_total_layer_temperature_C", "celsius"),
    ("leaf_area_index_high", "leaf_area_index_high_vegetation", "lai_hv", "LAI_high", "copy"),
    ("leaf_area_index_low", "leaf_area_index_low_vegetation", "lai_lv", "LAI_low", "copy"),
    ("potential_evaporation", "potential_evaporation", "pev", "potential_evaporation_mm", "depth"),
    ("runoff", "runoff", "ro", "runoff_mm", "depth"),
    ("skin_reservoir_content", "skin_reservoir_content", "src", "skin_reservoir_mm", "depth"),
    ("snow_albedo", "snow_albedo", "asn", "snow_albedo", "copy"),
    ("snow_density", "snow_density", "rsn", "snow_density_kgm3", "copy"),
    ("snow_evaporation", "snow_evaporation", "es", "snow_evaporation_mm", "depth"),
    ("snowfall", "snowfall", "sf", "snowfall_mm", "depth"),
    ("snowmelt", "snowmelt", "smlt", "snowmelt_mm", "depth"),
    ("snow_temperature", "temperature_of_snow_layer", "tsn", "snow_temperature_C", "celsius"),
    ("total_evaporation", "total_evaporation", "e", "total_evaporation_mm", "depth"),
    ("evaporation_bare_soil", "evaporation_from_bare_soil", "evabs", "evaporation_bare_soil_mm", "depth"),
    ("evaporation_open_water", "evaporation_from_open_water_surfaces_excluding_oceans", "evaow", "evaporation_open_water_mm", "depth"),
    ("evaporation_canopy", "evaporation_from_the_top_of_canopy", "evatc", "evaporation_canopy_mm", "depth"),
    ("vegetation_transpiration", "evaporation_from_vegetation_transpiration", "evavt", "vegetation_transpiration_mm", "depth"),
    ("subsurface_runoff", "sub_surface_runoff", "ssro", "subsurface_runoff_mm", "depth"),
    ("surface_runoff", "surface_runoff", "sro", "surface_runoff_mm", "depth"),
    ("surface_latent_heat_flux", "surface_latent_heat_flux", "slhf", "surface_latent_heat_flux_Wm2", "flux"),
    ("surface_net_solar_radiation", "surface_net_solar_radiation", "ssr", "surface_net_solar_Wm2", "flux"),
    ("surface_net_thermal_radiation", "surface_net_thermal_radiation", "str", "surface_net_thermal_Wm2", "flux"),
    ("surface_sensible_heat_flux", "surface_sensible_heat_flux", "sshf", "surface_sensible_heat_flux_Wm2", "flux"),
]
PRECIPITATION_FIELD = ("total_precipitation", "tp")
DERIVED_FIELDS = {
    "relative_humidity": ("RH", ("2m_temperature", "2m_dewpoint_temperature")),
    "vapour_pressure_deficit": ("VPD_kPa", ("2m_temperature", "2m_dewpoint_temperature")),
    "wind_speed": ("wind_speed", ("10m_u_component_of_wind", "10m_v_component_of_wind")),
    "wind_direction": ("wind_direction_deg", ("10m_u_component_of_wind", "10m_v_component_of_wind")),
    "rain_1d": ("rain_1d", ("total_precipitation",)),
    "rain_3d": ("rain_3d", ("total_precipitation",)),
    "rain_3d_log": ("rain_3d_log", ("total_precipitation",)),
    "is_rainy": ("is_rainy", ("total_precipitation",)),
}
CORE_FIELDS = (
    "2m_temperature", "2m_dewpoint_temperature", "surface_solar_radiation_downwards",
    "10m_u_component_of_wind", "10m_v_component_of_wind", "total_precipitation",
)
CORE_OUTPUTS = ("Tair_C", "RH", "Rsol_Wm2", "wind_speed", "rain_3d")
# Depth fields that are states, not running totals.
STATE_DEPTH_FIELDS = ("skin_reservoir_content",)
SERVER_NAMES = {
    "2m_temperature": "temperature_2m",
    "2m_dewpoint_temperature": "dewpoint_temperature_2m",
    "10m_u_component_of_wind": "u_component_of_wind_10m",
    "10m_v_component_of_wind": "v_component_of_wind_10m",
}
NON_NEGATIVE_TOTALS = ("tp", "ssrd")
KELVIN = 273.15
# End of fixed values.

SHORT_NAMES = {raw: short for _, raw, short, _, _ in SINGLE_FIELDS}
SHORT_NAMES[PRECIPITATION_FIELD[0]] = PRECIPITATION_FIELD[1]
OUTPUT_NAMES = {name: out for name, _, _, out, _ in SINGLE_FIELDS}
OUTPUT_NAMES.update({name: out for name, (out, _) in DERIVED_FIELDS.items()})
INPUTS = {name: (raw,) for name, raw, _, _, _ in SINGLE_FIELDS}
INPUTS.update({name: raws for name, (_, raws) in DERIVED_FIELDS.items()})
ACCUMULATED = {raw for _, raw, _, _, kind in SINGLE_FIELDS
               if kind in ("flux", "depth") and raw not in STATE_DEPTH_FIELDS}
ACCUMULATED.add(PRECIPITATION_FIELD[0])


def archive_fields(requested: Iterable[str] = ()) -> list[str]:
    """Archive fields a request needs; the core fields are always in."""
    needed = set(CORE_FIELDS)
    for name in requested:
        needed.update(INPUTS.get(name, ()))
    return sorted(needed)


def short_names(requested: Iterable[str] = ()) -> list[str]:
    return [SHORT_NAMES[raw] for raw in archive_fields(requested)]


def accumulated_short_names(requested: Iterable[str] = ()) -> list[str]:
    return [SHORT_NAMES[raw] for raw in archive_fields(requested) if raw in ACCUMULATED]


def server_band_names(requested: Iterable[str] = ()) -> list[str]:
    """Names on the server that already holds hourly increments: running
    totals carry an ``_hourly`` suffix there and must not be differenced."""
    return [f"{raw}_hourly" if raw in ACCUMULATED else SERVER_NAMES.get(raw, raw)
            for raw in archive_fields(requested)]


def weather_output_names(requested: Iterable[str] = ()) -> list[str]:
    extra = [OUTPUT_NAMES[name] for name in requested if name in OUTPUT_NAMES]
    return list(dict.fromkeys([*CORE_OUTPUTS, *extra]))


def celsius(kelvin: str | Column) -> Column:
    return col(kelvin) - F.lit(KELVIN)


def relative_humidity(t_c: Column, td_c: Column) -> Column:
    def exponent(t: Column) -> Column:
        return t * F.lit(17.625) / (t + F.lit(243.04))
    return clip(F.exp(exponent(td_c) - exponent(t_c)) * F.lit(100.0), 0.0, 100.0)


def saturation_pressure(t_c: Column) -> Column:
    return F.exp(t_c * F.lit(17.27) / (t_c + F.lit(237.3))) * F.lit(0.6108)


def vapour_deficit(t_c: Column, td_c: Column) -> Column:
    return clip(saturation_pressure(t_c) - saturation_pressure(td_c), low=0.0)


def wind_direction(u: Column, v: Column) -> Column:
    """Direction the wind blows from, degrees clockwise from north."""
    return F.pmod(F.degrees(F.atan2(u, v)) + F.lit(180.0), F.lit(360.0))


CONVERSIONS = {
    "celsius": celsius,
    "flux": lambda c: col(c) / F.lit(3600.0),
    "depth": lambda c: col(c) * F.lit(1000.0),
    "hecto": lambda c: col(c) / F.lit(100.0),
    "fraction": lambda c: F.when(col(c) <= 1.0, col(c) * F.lit(100.0)).otherwise(col(c)),
    "copy": col,
}


def with_weather_outputs(df: DataFrame) -> DataFrame:
    """Every output whose short-name inputs are present, in one projection."""
    have = set(df.columns)
    out = {target: CONVERSIONS[kind](short)
           for _, _, short, target, kind in SINGLE_FIELDS if short in have}
    if {"t2m", "d2m"} <= have:
        t, td = celsius("t2m"), celsius("d2m")
        out["RH"] = relative_humidity(t, td)
        out["VPD_kPa"] = vapour_deficit(t, td)
    if {"u10", "v10"} <= have:
        out["wind_speed"] = F.hypot("u10", "v10")
        out["wind_direction_deg"] = wind_direction(F.col("u10"), F.col("v10"))
    if "tp" in have:
        out["precip_mm"] = F.col("tp") * F.lit(1000.0)
    return df.withColumns(out)
