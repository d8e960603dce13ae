"""The catalogue of datasets: one table over images, spectra and other products, and its search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_words
from ..operators import predicates, rangelist
from ..operators.predicates import Condition, search_filter
from ..operators.relational import union_view
from .images import shape_search

# fixed values: columns of the dataset catalogue and their types, in order
DATASET_COLUMNS = {
    "dataproduct_type": "string", "dataproduct_subtype": "string", "calib_level": "smallint",
    "obs_collection": "string", "obs_id": "string", "obs_title": "string", "obs_publisher_did": "string",
    "obs_creator_did": "string", "access_url": "string", "access_format": "string", "access_estsize": "bigint",
    "target_name": "string", "target_class": "string", "s_ra": "double", "s_dec": "double", "s_fov": "double",
    "s_region": "array<struct<ra:double,dec:double>>", "s_resolution": "double", "t_min": "double",
    "t_max": "double", "t_exptime": "double", "t_resolution": "double", "em_min": "double", "em_max": "double",
    "em_res_power": "double", "o_ucd": "string", "pol_states": "string", "facility_name": "string",
    "instrument_name": "string", "s_xel1": "bigint", "s_xel2": "bigint", "t_xel": "bigint", "em_xel": "bigint",
    "pol_xel": "bigint", "s_pixel_scale": "double", "em_ucd": "string",
}


def _value(made) -> Column:
    return F.expr(made) if isinstance(made, str) else made


def publish(df: DataFrame, mapping: dict, base_url: str = "http://localhost/getproduct", collection: str = "unnamed",
            authority: str = "ivo://x-unregistered") -> DataFrame:
    """Rows of any product table as dataset rows.

    ``mapping`` gives an SQL expression or column per dataset column; what is
    not given comes from the product columns accref, mime, accsize and owner
    where they exist, else NULL.  ``calib_level`` is 0 unless given.
    """
    has = set(df.columns)
    defaults: dict[str, Column] = {"calib_level": F.lit(0), "obs_collection": F.lit(collection)}
    if "accref" in has:
        defaults["obs_id"] = F.col("accref")
        defaults["obs_publisher_did"] = F.concat(F.lit(f"{authority}/~?"), F.url_encode("accref"))
        defaults["access_url"] = F.concat(F.lit(f"{base_url}/"), F.url_encode("accref"))
    if "mime" in has:
        defaults["access_format"] = F.col("mime")
    if "accsize" in has:
        defaults["access_estsize"] = F.floor(F.col("accsize") / 1024)
    unknown = set(mapping) - set(DATASET_COLUMNS)
    if unknown:
        raise KeyError(f"no dataset columns {', '.join(sorted(unknown))}")
    made = {**defaults, **{k: _value(v) for k, v in mapping.items()}}
    return df.select(*((made[n] if n in made else F.lit(None)).cast(kind).alias(n)
                       for n, kind in DATASET_COLUMNS.items()))


def publish_images(df: DataFrame, mapping: dict | None = None, **options) -> DataFrame:
    """Image table rows as dataset rows; scales are degrees per pixel."""
    preset = {
        "dataproduct_type": F.lit("image"), "obs_title": "imageTitle", "s_ra": "centerAlpha", "s_dec": "centerDelta",
        "s_fov": "pixelScale[0] * pixelSize[0]", "s_region": "coverage", "t_min": "dateObs", "t_max": "dateObs",
        "em_min": "bandpassLo", "em_max": "bandpassHi", "o_ucd": F.lit("em.opt"),
        "s_resolution": "pixelScale[0] * 3600", "instrument_name": "instId", "s_xel1": "pixelSize[0]",
        "s_xel2": "pixelSize[1]", "s_pixel_scale": "pixelScale[0] * 3600",
    }
    return publish(df, {**preset, **(mapping or {})}, **options)


def publish_spectra(df: DataFrame, mapping: dict | None = None, params: dict | None = None, **options) -> DataFrame:
    """Spectrum table rows as dataset rows; ``params`` holds table-wide values by their ssa names."""
    params = params or {}
    constant = lambda name: F.lit(params.get(name))
    preset = {
        "dataproduct_type": F.lit("spectrum"), "obs_title": "ssa_dstitle", "obs_creator_did": "ssa_creatorDID",
        "s_ra": "ssa_location.ra", "s_dec": "ssa_location.dec", "s_fov": "ssa_aperture",
        "em_min": "ssa_specstart", "em_max": "ssa_specend", "t_exptime": "ssa_timeExt",
        "t_min": "ssa_dateObs - ssa_timeExt / 2", "t_max": "ssa_dateObs + ssa_timeExt / 2",
        "target_name": "ssa_targname", "target_class": "ssa_targclass", "obs_collection": constant("ssa_collection"),
        "instrument_name": constant("ssa_instrument"), "o_ucd": constant("ssa_fluxucd"),
        "em_ucd": constant("ssa_spectralucd"),
        "s_resolution": constant("ssa_spaceres").cast("double") / 3600,
    }
    return publish(df, {**preset, **(mapping or {})}, **options)


def dataset_catalogue(*published: DataFrame) -> DataFrame:
    """All dataset rows in one table."""
    return union_view(list(published), DATASET_COLUMNS)


def _intervals(value) -> list[tuple[float, float]]:
    """Pairs of limits: numbers, ``lo hi`` text, or a list of these; infinities are open ends."""
    items = value if isinstance(value, (list, tuple)) and not (
        len(value) == 2 and all(isinstance(v, (int, float)) for v in value)) else [value]
    out = []
    for item in items:
        if isinstance(item, str):
            numbers = [float(v) for v in item.split()]
            item = (numbers[0], numbers[-1])
        elif isinstance(item, (int, float)):
            item = (float(item), float(item))
        out.append(tuple(item))
    return out


def _listed(value) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def _overlap_or_inside(low: str, high: str, value) -> Column | None:
    tests = []
    for lo, hi in _intervals(value):
        tests.append(predicates.covers_value(low, high, lo) if lo == hi else predicates.overlaps(low, high, lo, hi))
    return predicates.disjunction(tests)


def _in_intervals(name: str):
    return lambda p, key: predicates.in_any_interval(name, _intervals(p[key]))


DATASET_CONDITIONS = [
    Condition(lambda p: [shape_search(s, "s_region") for s in _listed(p["POS"])], "POS"),
    Condition(lambda p: _overlap_or_inside("em_min", "em_max", p["BAND"]), "BAND"),
    Condition(lambda p: _overlap_or_inside("t_min", "t_max", p["TIME"]), "TIME"),
    Condition(lambda p: predicates.has_state("pol_states", _listed(p["POL"])), "POL"),
    Condition(lambda p: predicates.in_any_interval("s_fov", _intervals(p["FOV"])), "FOV"),
    Condition(lambda p: predicates.in_any_interval("s_resolution", _intervals(p["SPATRES"])), "SPATRES"),
    Condition(lambda p: predicates.in_any_interval("em_res_power", _intervals(p["SPECRP"])), "SPECRP"),
    Condition(lambda p: predicates.in_any_interval("t_exptime", _intervals(p["EXPTIME"])), "EXPTIME"),
    Condition(lambda p: predicates.in_any_interval("t_resolution", _intervals(p["TIMERES"])), "TIMERES"),
    Condition(lambda p: predicates.any_of_nocase("obs_publisher_did", _listed(p["ID"])), "ID"),
    Condition(lambda p: predicates.any_of("obs_collection", _listed(p["COLLECTION"])), "COLLECTION"),
    Condition(lambda p: predicates.any_of("facility_name", _listed(p["FACILITY"])), "FACILITY"),
    Condition(lambda p: predicates.any_of("instrument_name", _listed(p["INSTRUMENT"])), "INSTRUMENT"),
    Condition(lambda p: predicates.any_of("dataproduct_type", _listed(p["DPTYPE"])), "DPTYPE"),
    Condition(lambda p: predicates.any_of("calib_level", [int(v) for v in _listed_numbers(p["CALIB"])]), "CALIB"),
    Condition(lambda p: predicates.any_of("target_name", _listed(p["TARGET"])), "TARGET"),
    Condition(lambda p: predicates.any_of("access_format", _listed(p["FORMAT"])), "FORMAT"),
]


def _listed_numbers(value):
    return value if isinstance(value, (list, tuple)) else [value]


def search_datasets(df: DataFrame, params: dict) -> DataFrame:
    """Datasets by the seventeen parameters of the dataset search; several values of one are alternatives."""
    return df.filter(search_filter(DATASET_CONDITIONS, params))


def search_lines(df: DataFrame, params: dict) -> DataFrame:
    """Spectral lines by WAVELENGTH, CHEMICAL_ELEMENT and level energies, as range lists."""
    tests = [
        rangelist.range_filter("wavelength", params.get("WAVELENGTH"), "float"),
        rangelist.range_filter("initial_level_energy", params.get("INITIAL_LEVEL_ENERGY"), "float"),
        rangelist.range_filter("final_level_energy", params.get("FINAL_LEVEL_ENERGY"), "float"),
    ]
    if params.get("CHEMICAL_ELEMENT"):
        tests.append(rangelist.range_filter("chemical_element", params["CHEMICAL_ELEMENT"], "plain"))
    if params.get("LINENAME"):
        tests.append(has_words("linename", params["LINENAME"]))
    return df.filter(predicates.conjunction(tests))


# fixed values: range columns of planetary dataset tables
PLANETARY_PAIRS = (
    "time_", "time_sampling_step_", "time_exp_", "spectral_range_", "spectral_sampling_step_",
    "spectral_resolution_", "c1", "c2", "c3", "c1_resol_", "c2_resol_", "c3_resol_", "incidence_", "emergence_",
    "phase_",
)


def planetary_rows(df: DataFrame, values: dict, base_url: str = "http://localhost/getproduct") -> DataFrame:
    """Planetary dataset columns filled.

    ``values`` maps column names to expressions; a name from PLANETARY_PAIRS
    sets both ends at once from a (min, max) pair of expressions, or from one
    expression.  Sizes are in kilobytes.
    """
    made: dict[str, Column] = {}
    for pair in PLANETARY_PAIRS:
        low = high = None
        if pair in values:
            given = values[pair]
            low, high = given if isinstance(given, tuple) else (given, given)
        low, high = values.get(f"{pair}min", low), values.get(f"{pair}max", high)
        made[f"{pair}min"] = (F.lit(None) if low is None else _value(low)).cast("double")
        made[f"{pair}max"] = (F.lit(None) if high is None else _value(high)).cast("double")
    defaults = {"target_class": F.lit("UNKNOWN"), "time_scale": F.lit("UNKNOWN"), "dataset_id": F.lit("1"),
                "processing_level": F.lit(0)}
    for name in ("index_", "target_name", "spatial_frame_type", "instrument_host_name", "instrument_name",
                 "access_format", "target_region", *defaults):
        made[name] = _value(values[name]) if name in values else defaults.get(name, F.lit(None).cast("string"))
    if "accref" in df.columns:
        made["access_url"] = F.concat(F.lit(f"{base_url}/"), F.url_encode("accref"))
        made["access_estsize"] = F.floor(F.col("accsize") / 1024).cast("bigint")
        made["accref"] = F.col("accref")
    if "preview" in df.columns:
        made["preview_url"] = F.col("preview")
    return df.select(*(c.alias(n) for n, c in made.items()))
