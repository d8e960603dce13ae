"""Spectra as rows (spectrum_id, spectral, flux ...): cutouts, normalisation, metadata, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import regions, times
from ..functions.text import has_words
from ..functions.units import conversion_factor
from ..operators import predicates, rangelist
from ..operators.predicates import Condition


def normalise_flux(df: DataFrame, key: str = "spectrum_id", flux: str = "flux", error: str | None = None,
                   calibration: str | None = None, huge: bool = False) -> DataFrame:
    """Flux (and error) divided by each spectrum's maximum.

    Nothing happens to spectra already relative: to all of them, when
    ``calibration`` is that word, or to those whose calibration column says
    so.  Points without a key are one spectrum.  ``huge`` is for spectra too
    large for one task: maxima are then aggregated on the map side and joined
    back, and adaptive execution splits their rows.
    """
    if calibration is not None and calibration.lower() == "relative":
        return df
    if huge:
        maxima = df.groupBy(F.col(key).alias("__key")).agg(F.max(flux).alias("__max"))
        df_max = df.join(maxima, F.col(key).eqNullSafe(F.col("__key")))
    else:
        df_max = df.withColumn("__max", F.max(flux).over(Window.partitionBy(key)))
    factor = F.col("__max")
    if calibration is not None and calibration in df.columns:
        factor = F.when(F.lower(calibration) == "relative", F.lit(1.0)).otherwise(factor)
    changed = {flux: F.col(flux) / factor}
    if error:
        changed[error] = F.col(error) / factor
    return df_max.withColumns(changed).select(*df.columns)


def cutout(df: DataFrame, low_m: float, high_m: float, unit: str = "m", spectral: str = "spectral") -> DataFrame:
    """Points between limits given in metres, on an axis in ``unit``."""
    factor = conversion_factor("m", unit)
    return df.filter(F.col(spectral).between(low_m * factor, high_m * factor))


def spectral_limits(df: DataFrame, key: str = "spectrum_id", unit: str = "m", spectral: str = "spectral") -> DataFrame:
    """Start, end, extent and middle in metres per spectrum."""
    factor = conversion_factor("m", unit)
    limits = df.groupBy(key).agg((F.min(spectral) / factor).alias("ssa_specstart"),
                                 (F.max(spectral) / factor).alias("ssa_specend"))
    return limits.withColumns({
        "ssa_specext": F.col("ssa_specend") - F.col("ssa_specstart"),
        "ssa_specmid": (F.col("ssa_specstart") + F.col("ssa_specend")) / 2})


def spectrum_metadata(df: DataFrame, date: str, alpha: str, delta: str, aperture: str | None = None) -> DataFrame:
    """Adds observation date (MJD) and target position columns in the form spectrum searches use."""
    kind = df.schema[date].dataType.typeName()
    how = "timestamp" if kind.startswith("timestamp") else "string" if kind == "string" else "number"
    columns = {"ssa_dateObs": times.any_to_mjd(date, how), "ssa_location": regions.point(alpha, delta)}
    if aperture:
        columns["ssa_region"] = regions.circle(alpha, delta, F.col(aperture) / 2)
    return df.withColumns(columns)


def band_filter(low: str, high: str, band_name: str, text: str | None) -> Column | None:
    """BAND: numeric ranges overlap the covered interval, anything else names bands."""
    if not text:
        return None
    try:
        return rangelist.interval_filter(low, high, text)
    except rangelist.RangeError:
        return rangelist.range_filter(band_name, text, "plain")


# parameter -> maker of its predicate
SPECTRUM_PARAMETERS = {
    "POS": lambda p: rangelist.cone_filter("ra", "dec", p["POS"], float(p.get("SIZE") or 1) / 2),
    "BAND": lambda p: band_filter("ssa_specstart", "ssa_specend", "ssa_bandpass", p["BAND"]),
    "TIME": lambda p: rangelist.range_filter("ssa_dateObs", p["TIME"], "date", "mjd"),
    "FORMAT": lambda p: predicates.media_type("mime", p["FORMAT"]),
    "TARGETNAME": lambda p: rangelist.caseless_filter("ssa_targname", p["TARGETNAME"]),
    "TARGETPATTERN": lambda p: rangelist.shell_filter("ssa_targname", p["TARGETPATTERN"]),
    "TARGETCLASS": lambda p: rangelist.caseless_filter("ssa_targclass", p["TARGETCLASS"]),
    "TITLE": lambda p: has_words("ssa_dstitle", p["TITLE"]),
    "PUBDID": lambda p: rangelist.range_filter("ssa_pubDID", p["PUBDID"], "plain"),
    "CREATORDID": lambda p: rangelist.range_filter("ssa_creatorDID", p["CREATORDID"], "plain"),
    "COLLECTION": lambda p: rangelist.range_filter("ssa_collection", p["COLLECTION"], "plain"),
    "FLUXCALIB": lambda p: rangelist.caseless_filter("ssa_fluxcalib", p["FLUXCALIB"]),
    "WAVECALIB": lambda p: rangelist.caseless_filter("ssa_speccalib", p["WAVECALIB"]),
    "SNR": lambda p: rangelist.range_filter("ssa_snr", p["SNR"], "float"),
    "REDSHIFT": lambda p: rangelist.range_filter("ssa_redshift", p["REDSHIFT"], "float"),
    "SPECRP": lambda p: rangelist.range_filter("ssa_specres", p["SPECRP"], "float"),
    "APERTURE": lambda p: rangelist.range_filter("ssa_aperture", p["APERTURE"], "float"),
    "SPATRES": lambda p: rangelist.range_filter("ssa_spaceres", p["SPATRES"], "float"),
    "MTIME": lambda p: rangelist.range_filter("ssa_pdate", p["MTIME"], "date"),
    "WILDTARGET": lambda p: rangelist.shell_filter("ssa_targname", p["WILDTARGET"], nocase=False),
}


def search_spectra(df: DataFrame, params: dict, constants: dict | None = None) -> DataFrame:
    """Spectra by the parameters of the spectrum search; all given ones must hold.

    ``constants`` holds values that are the same for the whole table; a
    parameter on one of them is decided before any data are read.
    """
    constants = constants or {}
    by_constant = {"TARGETCLASS": "ssa_targclass", "FLUXCALIB": "ssa_fluxcalib", "WAVECALIB": "ssa_speccalib",
                   "COLLECTION": "ssa_collection", "PUBDID": "ssa_pubDID"}
    tests = []
    for name, maker in SPECTRUM_PARAMETERS.items():
        if params.get(name) in (None, ""):
            continue
        constant = constants.get(by_constant.get(name))
        if constant is not None:
            wanted = params[name].lower()
            tests.append(predicates.on_constant(constant.lower(), lambda value, wanted=wanted: rangelist.names_value(wanted, value)))
        else:
            tests.append(Condition(maker, name).build(params))
    return df.filter(predicates.conjunction(tests))
