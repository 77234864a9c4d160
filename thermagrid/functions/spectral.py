"""Digital numbers to reflectance, surface temperature and spectral indices."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import col, guarded_ratio

# Product band names, scale factors and output names.
FINE_BANDS = {
    "coastal": "SR_B1", "blue": "SR_B2", "green": "SR_B3", "red": "SR_B4",
    "nir": "SR_B5", "swir1": "SR_B6", "swir2": "SR_B7",
}
COVARIATE_BANDS = {
    "coastal": "B1", "blue": "B2", "green": "B3", "red": "B4",
    "red_edge_1": "B5", "red_edge_2": "B6", "red_edge_3": "B7", "nir": "B8",
    "red_edge_4": "B8A", "swir1": "B11", "swir2": "B12",
}
FINE_AUXILIARY = {
    "surface_emissivity": ("ST_EMIS", 0.0001),
    "emissivity_uncertainty": ("ST_EMSD", 0.0001),
    "atmospheric_transmittance": ("ST_ATRAN", 0.0001),
    "cloud_distance_km": ("ST_CDIST", 0.01),
    "LST_uncertainty_K": ("ST_QA", 0.01),
}
COVARIATE_AUXILIARY = {"AOT": ("AOT", 0.001), "water_vapour_cm": ("WVP", 0.001)}
THERMAL_BAND = "ST_B10"
CORE_INDICES = ("NDVI", "NDBI", "ALBEDO")
# End of fixed values.


def fine_reflectance(dn: str | Column) -> Column:
    return col(dn) * F.lit(2.75e-5) - F.lit(0.2)


def covariate_reflectance(dn: str | Column) -> Column:
    return col(dn) / F.lit(10000.0)


def surface_temperature(dn: str | Column) -> Column:
    """Thermal digital number to kelvin."""
    return col(dn) * F.lit(0.00341802) + F.lit(149.0)


def normalized_difference(a: Column, b: Column) -> Column:
    return guarded_ratio(a - b, a + b)


def enhanced_vegetation(nir: Column, red: Column, blue: Column) -> Column:
    """The denominator can reach zero and has no guard: NULL then."""
    return F.try_divide((nir - red) * F.lit(2.5),
                        nir + red * F.lit(6.0) - blue * F.lit(7.5) + F.lit(1.0))


def soil_adjusted_vegetation(nir: Column, red: Column) -> Column:
    return F.try_divide((nir - red) * F.lit(1.5), nir + red + F.lit(0.5))


def spectral_index(name: str, r: dict[str, Column]) -> Column:
    """One index by name from a dictionary of reflectance columns."""
    if name == "ALBEDO":
        return (r["blue"] + r["green"] + r["red"] + r["nir"]) / F.lit(4.0)
    if name == "EVI":
        return enhanced_vegetation(r["nir"], r["red"], r["blue"])
    if name == "SAVI":
        return soil_adjusted_vegetation(r["nir"], r["red"])
    if name == "BSI":
        return normalized_difference(r["swir1"] + r["red"], r["nir"] + r["blue"])
    pair = {
        "NDVI": ("nir", "red"), "NDBI": ("swir1", "nir"), "NDWI": ("green", "nir"),
        "MNDWI": ("green", "swir1"), "NDMI": ("nir", "swir1"),
        "urban_index": ("swir2", "nir"),
    }[name]
    return normalized_difference(r[pair[0]], r[pair[1]])


INDEX_NAMES = ("NDVI", "NDBI", "ALBEDO", "NDWI", "MNDWI", "NDMI", "EVI", "SAVI", "BSI",
               "urban_index")


def _requested_columns(requested: Iterable[str], auxiliary: dict) -> list[str]:
    """Output names (without sensor suffix) a request asks for, core first."""
    names = list(CORE_INDICES)
    for item in requested:
        if item.startswith("reflectance_"):
            names.append("SR_" + item.removeprefix("reflectance_"))
        elif item in INDEX_NAMES or item in auxiliary:
            names.append(item)
        elif item == "cloud_distance":
            names.append("cloud_distance_km")
        elif item == "LST_uncertainty":
            names.append("LST_uncertainty_K")
        elif item == "aerosol_optical_thickness":
            names.append("AOT")
        elif item == "water_vapour":
            names.append("water_vapour_cm")
    return list(dict.fromkeys(names))


def fine_output_names(requested: Iterable[str] = ()) -> list[str]:
    names = _requested_columns(requested, FINE_AUXILIARY)
    keep = [n for n in names if n not in COVARIATE_AUXILIARY
            and not (n.startswith("SR_") and n.removeprefix("SR_") not in FINE_BANDS)]
    return ["LST_K", *keep]


def covariate_output_names(requested: Iterable[str] = ()) -> list[str]:
    names = _requested_columns(requested, COVARIATE_AUXILIARY)
    return [f"{n}_S2" for n in names if n not in FINE_AUXILIARY]


def _outputs(names: Iterable[str], r: dict[str, Column], auxiliary: dict) -> dict[str, Column]:
    out = {}
    for name in names:
        if name.startswith("SR_"):
            out[name] = r[name.removeprefix("SR_")]
        elif name in auxiliary:
            source, scale = auxiliary[name]
            out[name] = F.col(source) * F.lit(scale)
        else:
            out[name] = spectral_index(name, r)
    return out


def with_fine_variables(df: DataFrame, requested: Iterable[str] = ()) -> DataFrame:
    """Add surface temperature, the core indices and the requested extras."""
    names = fine_output_names(requested)
    r = {band: fine_reflectance(source) for band, source in FINE_BANDS.items()}
    columns = {"LST_K": surface_temperature(THERMAL_BAND)}
    columns.update(_outputs(names[1:], r, FINE_AUXILIARY))
    return df.withColumns(columns)


def with_covariate_variables(df: DataFrame, requested: Iterable[str] = ()) -> DataFrame:
    names = [n.removesuffix("_S2") for n in covariate_output_names(requested)]
    r = {band: covariate_reflectance(source) for band, source in COVARIATE_BANDS.items()}
    columns = _outputs(names, r, COVARIATE_AUXILIARY)
    return df.withColumns({f"{name}_S2": value for name, value in columns.items()})
