"""Unit conversion factors and unit-aware projections.

Factors are worked out on the driver from short unit names; the data only
sees a multiplication with a literal.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import column_unit, with_metadata
from ._args import col, num


class UnitError(ValueError):
    """A unit is unknown or two units do not measure the same thing."""


PLANCK_H = 6.626070040e-34
LIGHT_C = 299792458.0

# fixed values: unit -> (factor, base unit)
BASE_UNITS = {
    "a": (31557600.0, "s"), "A": (1, "A"), "adu": (1, "adu"), "Angstrom": (1e-10, "m"),
    "angstrom": (1e-10, "m"), "\u00c5": (1e-10, "m"), "\u212b": (1e-10, "m"), "AU": (1.49598e11, "m"), "au": (1.49598e11, "m"),
    "arcmin": (math.pi / 180 / 60, "rad"), "arcsec": (math.pi / 180 / 3600, "rad"), "barn": (1, "barn"),
    "beam": (1, "beam"), "bit": (1, "bit"), "bin": (1, "bin"), "byte": (1, "byte"), "C": (1, "C"),
    "cd": (1, "cd"), "ct": (1, "ct"), "count": (1, "ct"), "chan": (1, "chan"), "D": (1e-19 / 3, "D"),
    "d": (86400.0, "s"), "deg": (math.pi / 180, "rad"), "erg": (1e-7, "J"), "eV": (1.6021766208e-19, "J"),
    "F": (1, "F"), "g": (1e-3, "kg"), "G": (1e-4, "T"), "h": (3600.0, "s"), "H": (1, "H"), "Hz": (1, "Hz"),
    "J": (1, "J"), "Jy": (1, "Jy"), "K": (1, "K"), "lm": (1, "lm"), "lx": (1, "lx"),
    "lyr": (9460730472580800.0, "m"), "m": (1, "m"), "mag": (1, "mag"), "mas": (math.pi / 180 / 3.6e6, "rad"),
    "min": (60.0, "s"), "mol": (1, "mol"), "N": (1, "N"), "Ohm": (1, "Ohm"), "Pa": (1, "Pa"),
    "pc": (3.0857e16, "m"), "ph": (1, "ph"), "photon": (1, "ph"), "pix": (1, "pix"), "pixel": (1, "pix"),
    "R": (1, "R"), "rad": (1, "rad"), "Ry": (2.17989e-18, "J"), "s": (1, "s"), "S": (1, "S"),
    "solLum": (3.826e26, "W"), "solMass": (1.989e30, "kg"), "solRad": (6.9559e8, "m"), "sr": (1, "sr"),
    "T": (1, "T"), "u": (1.66053886e-27, "kg"), "V": (1, "V"), "voxel": (1, "voxel"), "W": (1, "W"),
    "Wb": (1, "Wb"), "yr": (31557600.0, "s"), "cy": (3155760000.0, "s"),
}
# fixed values: units taking no prefix
UNPREFIXED = {
    "AU", "au", "D", "Ry", "arcmin", "beam", "bin", "chan", "d", "h", "mas", "min", "ph", "photon", "pix", "pixel",
    "solLum", "solMass", "solRad", "voxel", "cy",
}
# fixed values: decimal prefixes
PREFIXES = {
    "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15, "a": 1e-18, "z": 1e-21,
    "y": 1e-24, "da": 1e1, "h": 1e2, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "P": 1e15, "E": 1e18,
    "Z": 1e21, "Y": 1e24,
}


def _atom(name: str) -> tuple[float, str]:
    if name in BASE_UNITS:
        return BASE_UNITS[name]
    for prefix in sorted(PREFIXES, key=len, reverse=True):
        rest = name[len(prefix):]
        if name.startswith(prefix) and rest in BASE_UNITS and rest not in UNPREFIXED:
            factor, base = BASE_UNITS[rest]
            return PREFIXES[prefix] * factor, base
    raise UnitError(f"unknown unit {name!r}")


_FACTOR = re.compile(r"\s*([./*]?)\s*([A-Za-z\u00c5\u212b]+)(?:(?:\*\*|\^)?\(?([+-]?\d+(?:\.\d+)?)\)?)?")


def si_form(unit: str) -> tuple[float, dict[str, float]]:
    """Factor and powers of base units of a product such as ``km/s`` or ``cm**-1``."""
    rest, total, powers = unit.strip(), 1.0, {}
    lead = re.match(r"(\d+(?:\.\d+)?(?:\*\*[+-]?\d+)?(?:[eE][+-]?\d+)?)\s*(?=[A-Za-z\u00c5\u212b])", rest)
    if lead:
        number = lead.group(1)
        if "**" in number:
            base, power = number.split("**")
            total = float(base) ** int(power)
        else:
            total = float(number)
        rest = rest[lead.end():]
    while rest:
        match = _FACTOR.match(rest)
        if not match:
            raise UnitError(f"cannot read unit {unit!r}")
        operator, name, power = match.groups()
        exponent = float(power or 1) * (-1 if operator == "/" else 1)
        factor, base = _atom(name)
        total *= factor**exponent
        powers[base] = powers.get(base, 0.0) + exponent
        rest = rest[match.end():].lstrip()
    return total, {base: power for base, power in powers.items() if power}


def conversion_factor(source: str, target: str) -> float:
    """What to multiply a quantity in ``source`` with to get ``target``."""
    if source == target:
        return 1.0
    factor1, powers1 = si_form(source)
    factor2, powers2 = si_form(target)
    if powers1 == powers2:
        return factor1 / factor2
    # wave numbers are energies
    if powers1 == {"m": -1.0} and powers2 == {"J": 1.0}:
        return factor1 / factor2 * PLANCK_H * LIGHT_C
    if powers1 == {"J": 1.0} and powers2 == {"m": -1.0}:
        return factor1 / factor2 / (PLANCK_H * LIGHT_C)
    raise UnitError(f"{source} and {target} do not measure the same thing")


def convert(value, source: str, target: str) -> Column:
    """A column between two units; arrays are converted element by element."""
    return num(value) * F.lit(conversion_factor(source, target))


def convert_array(values, source: str, target: str) -> Column:
    factor = F.lit(conversion_factor(source, target))
    return F.transform(col(values), lambda v: v * factor)


def in_unit(df: DataFrame, name: str, target: str, out: str | None = None) -> DataFrame:
    """Adds a column in another unit, taking the unit declared for the source column."""
    source = column_unit(df, name)
    if not source:
        raise UnitError(f"column {name} declares no unit")
    out = out or name
    df = df.withColumn(out, convert(name, source, target))
    return with_metadata(df, out, unit=target)


def harmonise(df: DataFrame, target: dict[str, str | None]) -> DataFrame:
    """One projection bringing columns to the units of a target table.

    ``target`` maps column names to units; a missing column is an error.
    """
    missing = [name for name in target if name not in df.columns]
    if missing:
        raise UnitError(f"columns missing for unit conversion: {', '.join(missing)}")
    changed = {}
    for name, unit in target.items():
        source = column_unit(df, name)
        if source and unit and source != unit:
            changed[name] = (convert(name, source, unit), unit)
    columns = [changed[c][0].alias(c, metadata={**df.schema[c].metadata, "unit": changed[c][1]})
               if c in changed else F.col(c) for c in df.columns]
    return df.select(*columns)


# --- spectral axes ---------------------------------------------------------

_WAVELENGTH = {"m": 1.0, "mm": 1e-3, "um": 1e-6, "nm": 1e-9, "Angstrom": 1e-10}
_PLANCK_EV = 4.13566733e-15
_FREQUENCY = {
    "Hz": 1.0, "kHz": 1e3, "MHz": 1e6, "GHz": 1e9, "eV": 1 / _PLANCK_EV, "keV": 1e3 / _PLANCK_EV,
    "MeV": 1e6 / _PLANCK_EV, "GeV": 1e9 / _PLANCK_EV, "TeV": 1e12 / _PLANCK_EV,
}


def spectral(value, source: str, target: str) -> Column:
    """Wavelength, frequency or energy into each other."""
    value = num(value)
    for unit in (source, target):
        if unit not in _WAVELENGTH and unit not in _FREQUENCY:
            raise UnitError(f"{unit} is no spectral unit")
    if source in _WAVELENGTH:
        if target in _WAVELENGTH:
            return value * (_WAVELENGTH[source] / _WAVELENGTH[target])
        return LIGHT_C / (value * _WAVELENGTH[source]) / _FREQUENCY[target]
    if target in _FREQUENCY:
        return value * (_FREQUENCY[source] / _FREQUENCY[target])
    return LIGHT_C / (value * _FREQUENCY[source]) / _WAVELENGTH[target]


_AU = 1.49597870691e11
_PARSEC = _AU / 2 / math.tan(math.radians(0.5 / 3600))
# fixed values: distance units in metres; the largest distance a parallax stands for, in pc
DISTANCES = {
    "m": 1.0, "km": 1e3, "AU": _AU, "pc": _PARSEC, "kpc": 1e3 * _PARSEC, "Mpc": 1e6 * _PARSEC,
    "lyr": LIGHT_C * 31557600.0,
}
MAX_DISTANCE = 1e7


def parallax_to_distance(parallax, unit: str = "arcsec", target: str = "pc") -> Column:
    arcsec = convert(parallax, unit, "arcsec")
    parsecs = F.when(arcsec < 1 / MAX_DISTANCE, F.lit(MAX_DISTANCE)).otherwise(1 / arcsec)
    return parsecs * (_PARSEC / DISTANCES[target])


def distance_to_parallax(distance, unit: str = "pc", target: str = "arcsec") -> Column:
    parsecs = num(distance) * (DISTANCES[unit] / _PARSEC)
    arcsec = F.when(parsecs > MAX_DISTANCE, F.lit(0.0)).otherwise(1 / parsecs)
    return arcsec * conversion_factor("arcsec", target)
