"""Reference frame transforms as matrix algebra on columns.

The matrices of a chain are multiplied on the driver; rows see at most three
projections.  Chains through FK4 carry velocities, as the elliptic terms of
aberration need them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import times
from ._args import num
from .sphere import vector_dec, vector_ra

ARCSEC = math.pi / 180 / 3600
JD_J2000 = 2451545.0
JULIAN_CENTURY = 36525.0


def julian_epoch(year: float) -> float:
    return JD_J2000 + (year - 2000.0) * times.JULIAN_YEAR


def besselian_epoch(year: float) -> float:
    return times.JD_B1900 + (year - 1900.0) * times.TROPICAL_YEAR


JD_B1950 = besselian_epoch(1950.0)
_JD_B1850 = besselian_epoch(1850.0)


@dataclass(frozen=True)
class Frame:
    """A frame with the JD of its equinox (where it has one)."""

    name: str
    equinox: float | None = None


ICRS = Frame("ICRS")
FK5 = Frame("FK5", JD_J2000)
FK4 = Frame("FK4", JD_B1950)
GALACTIC = Frame("GALACTIC")
SUPER_GALACTIC = Frame("SUPER_GALACTIC")


def ecliptic(jd: float = JD_J2000) -> Frame:
    return Frame("ECLIPTIC", jd)


def fk5(year: float) -> Frame:
    return Frame("FK5", julian_epoch(year))


def fk4(year: float) -> Frame:
    return Frame("FK4", besselian_epoch(year))


def _rot_x(a: float) -> np.ndarray:
    c, s = math.cos(a), math.sin(a)
    return np.array([[1, 0, 0], [0, c, s], [0, -s, c]])


def _rot_y(a: float) -> np.ndarray:
    c, s = math.cos(a), math.sin(a)
    return np.array([[c, 0, -s], [0, 1, 0], [s, 0, c]])


def _rot_z(a: float) -> np.ndarray:
    c, s = math.cos(a), math.sin(a)
    return np.array([[c, s, 0], [-s, c, 0], [0, 0, 1]])


def _direction(lon: float, lat: float) -> np.ndarray:
    lon, lat = math.radians(lon), math.radians(lat)
    return np.array([math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)])


def _from_pole(pole, zero) -> np.ndarray:
    z = _direction(*pole)
    x = _direction(*zero)
    return np.array([x, np.cross(z, x), z])


def _from_rotation_vector(v: np.ndarray) -> np.ndarray:
    angle = float(np.linalg.norm(v))
    x, y, z = v / angle
    k = np.array([[0, z, -y], [-z, 0, x], [y, -x, 0]])
    axis = np.outer((x, y, z), (x, y, z))
    return math.cos(angle) * np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * axis


def _precession(zeta: float, z: float, theta: float) -> np.ndarray:
    return _rot_z(-z * ARCSEC) @ _rot_y(theta * ARCSEC) @ _rot_z(-zeta * ARCSEC)


def precession_fk5(jd_from: float, jd_to: float) -> np.ndarray:
    """Precession matrix with the IAU 1976 angles (Lieske, A&A 73, 282)."""
    big, t = (jd_from - JD_J2000) / JULIAN_CENTURY, (jd_to - jd_from) / JULIAN_CENTURY
    rate = 2306.2181 + 1.39656 * big - 0.000139 * big**2
    zeta = rate * t + (0.30188 - 0.000344 * big) * t**2 + 0.017998 * t**3
    z = rate * t + (1.09468 + 0.000066 * big) * t**2 + 0.018203 * t**3
    theta = ((2004.3109 - 0.85330 * big - 0.000217 * big**2) * t
             - (0.42665 + 0.000217 * big) * t**2 - 0.041833 * t**3)
    return _precession(zeta, z, theta)


def precession_fk4(jd_from: float, jd_to: float) -> np.ndarray:
    """Precession matrix with Newcomb's angles (Kinoshita 1975)."""
    century = times.TROPICAL_YEAR * 100
    big, t = (jd_from - _JD_B1850) / century, (jd_to - jd_from) / century
    rate = 2303.5548 + 1.39720 * big + 0.000059 * big**2
    zeta = rate * t + (0.30242 - 0.000269 * big) * t**2 + 0.017996 * t**3
    z = rate * t + (1.09478 + 0.000387 * big) * t**2 + 0.018324 * t**3
    theta = ((2005.1125 - 0.85294 * big - 0.000365 * big**2) * t
             + (-0.42647 - 0.000365 * big) * t**2 - 0.041802 * t**3)
    return _precession(zeta, z, theta)


def obliquity_matrix(jd: float) -> np.ndarray:
    """Equatorial to ecliptic of date."""
    t = (jd - JD_J2000) / JULIAN_CENTURY
    return _rot_x((84381.448 - 46.8150 * t - 0.00059 * t**2 + 0.001813 * t**3) * ARCSEC)


# fixed values: J2000 equatorial to galactic
J2000_TO_GALACTIC = np.array([
    [-0.054875539695716, -0.873437107995315, -0.483834985836994],
    [0.494109453305607, -0.444829589431879, 0.746982251810510],
    [-0.867666135847849, -0.198076386130820, 0.455983795721093]])
# fixed values: galactic pole and zero point in B1950, supergalactic ones in galactic coordinates
B1950_TO_GALACTIC = _from_pole((192.25, 27.4), (265.6108440311, -28.9167903484))
GALACTIC_TO_SUPER = _from_pole((47.37, 6.32), (137.37, 0.0))
# fixed values: orientation of FK5 in ICRS (mas) and its spin (mas per year)
FK5_TO_ICRS = _from_rotation_vector(np.array([-19.9e-3, -9.1e-3, 22.9e-3]) * ARCSEC)
FK5_SPIN = np.array([-0.30e-3, 0.60e-3, 0.70e-3]) * 100.0
# fixed values: FK4 B1950 to FK5 J2000 with velocities (Yallop et al., AJ 97, 274)
FK4_TO_FK5 = np.array([
    [0.999925678186902, -0.011182059642247, -0.004857946558960,
     0.000002423950176, -0.000000027106627, -0.000000011776558],
    [0.011182059571766, 0.999937478448132, -0.000027176441185,
     0.000000027106627, 0.000002723978783, -0.000000000065874],
    [0.004857946721186, -0.000027147426489, 0.9999881997387700,
     0.000000011776559, -0.000000000065816, 0.000002424101735],
    [-0.000541652366951, -0.237968129744288, 0.436227555856097,
     0.999947035154614, -0.011182506121805, -0.004857669684959],
    [0.237917612131583, -0.002660763319071, -0.008537771074048,
     0.011182506007242, 0.999958833818833, -0.000027184471371],
    [-0.436111276039270, 0.012259092261564, 0.002119110818172,
     0.004857669948650, -0.000027137309539, 1.000009560363559]])
# fixed values: the same by the tables of the Fortran SLALIB, by column, and their inverse
FK4_TO_FK5_SLA = np.array([
    [+0.9999256782, +0.0111820610, +0.0048579479, -0.000551, +0.238514, -0.435623],
    [-0.0111820611, +0.9999374784, -0.0000271474, -0.238565, -0.002667, +0.012254],
    [-0.0048579477, -0.0000271765, +0.9999881997, +0.435739, -0.008541, +0.002117],
    [+0.00000242395018, +0.00000002710663, +0.00000001177656, +0.99994704, +0.01118251, +0.00485767],
    [-0.00000002710663, +0.00000242397878, -0.00000000006582, -0.01118251, +0.99995883, -0.00002714],
    [-0.00000001177656, -0.00000000006587, +0.00000242410173, -0.00485767, -0.00002718, +1.00000956]]).T
FK5_TO_FK4 = np.array([
    [+0.9999256795, -0.0111814828, -0.0048590040, -0.000551, -0.238560, +0.435730],
    [+0.0111814828, +0.9999374849, -0.0000271557, +0.238509, -0.002667, -0.008541],
    [+0.0048590039, -0.0000271771, +0.9999881946, -0.435614, +0.012254, +0.002117],
    [-0.00000242389840, +0.00000002710544, +0.00000001177742, +0.99990432, -0.01118145, -0.00485852],
    [-0.00000002710544, -0.00000242392702, +0.00000000006585, +0.01118145, +0.99991613, -0.00002716],
    [-0.00000001177742, +0.00000000006585, -0.00000242404995, +0.00485852, -0.00002717, +0.99996684]]).T
# fixed values: elliptic terms of aberration at B1950 (position; change per tropical century in arcsec)
E_TERMS = np.array([-1.62557e-6, -0.31919e-6, -0.13843e-6])
E_TERMS_RATE = np.array([1.245e-3, -1.580e-3, -0.659e-3])
# fixed values: km/s per AU and century
AU_PER_CENTURY = 36525 * 86400.0 / 1.49597870691e8
AU_PER_CENTURY_SLA = 21.095


def _six(m: np.ndarray) -> np.ndarray:
    zero = np.zeros((3, 3))
    return np.block([[m, zero], [zero, m]])


def _spin_block(spin: np.ndarray) -> np.ndarray:
    """Adds r x spin to the velocity."""
    x, y, z = spin
    cross = np.array([[0, z, -y], [-z, 0, x], [y, -x, 0]])
    return np.block([[np.eye(3), np.zeros((3, 3))], [cross, np.eye(3)]])


def _to_hub(frame: Frame) -> list:
    """Steps from a frame to FK5 J2000: 6x6 matrices and the word 'fk4'."""
    if frame.name == "FK5":
        return [_six(precession_fk5(frame.equinox, JD_J2000))]
    if frame.name == "FK4":
        return [_six(precession_fk4(frame.equinox, JD_B1950)), "fk4"]
    if frame.name == "GALACTIC":
        return [_six(J2000_TO_GALACTIC.T)]
    if frame.name == "SUPER_GALACTIC":
        return [_six(J2000_TO_GALACTIC.T @ GALACTIC_TO_SUPER.T)]
    if frame.name == "ECLIPTIC":
        return [_six(precession_fk5(frame.equinox, JD_J2000) @ obliquity_matrix(frame.equinox).T)]
    if frame.name == "ICRS":
        spin_icrs = FK5_TO_ICRS @ FK5_SPIN
        return [_six(FK5_TO_ICRS.T) @ _spin_block(-spin_icrs)]
    raise ValueError(f"unknown reference frame {frame.name}")


def _from_hub(frame: Frame) -> list:
    if frame.name == "FK5":
        return [_six(precession_fk5(JD_J2000, frame.equinox))]
    if frame.name == "FK4":
        return ["fk5", _six(precession_fk4(JD_B1950, frame.equinox))]
    if frame.name == "GALACTIC":
        return [_six(J2000_TO_GALACTIC)]
    if frame.name == "SUPER_GALACTIC":
        return [_six(GALACTIC_TO_SUPER @ J2000_TO_GALACTIC)]
    if frame.name == "ECLIPTIC":
        return [_six(obliquity_matrix(frame.equinox) @ precession_fk5(JD_J2000, frame.equinox))]
    if frame.name == "ICRS":
        return [_six(FK5_TO_ICRS) @ _spin_block(FK5_SPIN)]
    raise ValueError(f"unknown reference frame {frame.name}")


def _chain(source: Frame, target: Frame) -> list:
    """Shortest list of steps, adjacent matrices multiplied."""
    galactic = {"GALACTIC": np.eye(3), "SUPER_GALACTIC": GALACTIC_TO_SUPER}
    if source == target:
        steps = []
    elif source.name == target.name == "FK5":
        steps = [_six(precession_fk5(source.equinox, target.equinox))]
    elif source.name == target.name == "FK4":
        steps = [_six(precession_fk4(source.equinox, target.equinox))]
    elif source.name == "FK4" and target.name in galactic:
        steps = [_six(galactic[target.name] @ B1950_TO_GALACTIC @ precession_fk4(source.equinox, JD_B1950))]
    elif source.name in galactic and target.name == "FK4":
        steps = [_six(precession_fk4(JD_B1950, target.equinox) @ B1950_TO_GALACTIC.T @ galactic[source.name].T)]
    elif source.name in galactic and target.name in galactic:
        steps = [_six(galactic[target.name] @ galactic[source.name].T)]
    else:
        steps = _to_hub(source) + _from_hub(target)
    merged: list = []
    for step in steps:
        if merged and not isinstance(step, str) and not isinstance(merged[-1], str):
            merged[-1] = step @ merged[-1]
        else:
            merged.append(step)
    return merged


def rotation(source: Frame, target: Frame) -> np.ndarray | None:
    """The 3x3 matrix between two frames, or None where elliptic terms come in."""
    steps = _chain(source, target)
    if any(isinstance(s, str) for s in steps):
        return None
    return steps[0][:3, :3] if steps else np.eye(3)


def _dot(row, names) -> Column:
    total = None
    for factor, name in zip(row, names):
        if factor == 0.0:
            continue
        term = F.col(name) if factor == 1.0 else F.lit(float(factor)) * F.col(name)
        total = term if total is None else total + term
    return F.lit(0.0) if total is None else total


def _linear(df: DataFrame, matrix: np.ndarray, names) -> DataFrame:
    return df.withColumns({name: _dot(matrix[i], names) for i, name in enumerate(names)})


def _fk4_to_fk5(df: DataFrame, names, sla: bool) -> DataFrame:
    r, v = names[:3], names[3:]
    ra, rv = _dot(E_TERMS, r), _dot(E_TERMS_RATE, r)
    va = _dot(E_TERMS, v)
    clean = {}
    for i in range(3):
        clean[r[i]] = F.col(r[i]) - float(E_TERMS[i]) + ra * F.col(r[i])
        speed = F.col(v[i]) - float(E_TERMS_RATE[i]) + rv * F.col(r[i])
        if not sla:
            speed = speed + va * F.col(r[i]) + va * F.col(v[i])
        clean[v[i]] = speed
    return _linear(df.withColumns(clean), FK4_TO_FK5_SLA if sla else FK4_TO_FK5, names)


def _fk5_to_fk4(df: DataFrame, names) -> DataFrame:
    df = _linear(df, FK5_TO_FK4, names)
    r, v = names[:3], names[3:]
    ra, rv = _dot(E_TERMS, r), _dot(E_TERMS_RATE, r)
    size = F.sqrt(F.col(r[0]) * F.col(r[0]) + F.col(r[1]) * F.col(r[1]) + F.col(r[2]) * F.col(r[2]))
    shifted = [F.col(r[i]) + float(E_TERMS[i]) * size - ra * F.col(r[i]) for i in range(3)]
    length = F.sqrt(shifted[0] * shifted[0] + shifted[1] * shifted[1] + shifted[2] * shifted[2])
    df = df.withColumn("__length", length)
    out = {}
    for i in range(3):
        out[r[i]] = F.col(r[i]) + float(E_TERMS[i]) * F.col("__length") - ra * F.col(r[i])
        out[v[i]] = F.col(v[i]) + float(E_TERMS_RATE[i]) * F.col("__length") - rv * F.col(r[i])
    return df.withColumns(out).drop("__length")


_STATE = tuple(f"__frame_{c}" for c in ("x", "y", "z", "u", "v", "w"))


def _run_chain(df: DataFrame, steps, sla: bool) -> DataFrame:
    for step in steps:
        if not isinstance(step, str):
            df = _linear(df, step, _STATE)
        elif step == "fk4":
            df = _fk4_to_fk5(df, _STATE, sla)
        else:
            df = _fk5_to_fk4(df, _STATE)
    return df


def transform_position(df: DataFrame, source: Frame, target: Frame, ra="ra", dec="dec",
                       out_ra: str = "ra_out", out_dec: str = "dec_out") -> DataFrame:
    """Adds a position in another frame."""
    ra, dec = F.radians(num(ra)), F.radians(num(dec))
    x, y, z = _STATE[:3]
    df = df.withColumns({x: F.cos(dec) * F.cos(ra), y: F.cos(dec) * F.sin(ra), z: F.sin(dec)})
    matrix = rotation(source, target)
    if matrix is not None:
        df = _linear(df, matrix, _STATE[:3])
    else:
        df = df.withColumns({name: F.lit(0.0) for name in _STATE[3:]})
        df = _run_chain(df, _chain(source, target), sla=False)
    df = df.withColumns({out_ra: vector_ra(x, y), out_dec: vector_dec(x, y, z)})
    return df.drop(*_STATE)


def rotate_position(position, source: Frame, target: Frame) -> Column:
    """A position struct in another frame, for frames a rotation connects."""
    matrix = rotation(source, target)
    if matrix is None:
        raise ValueError("this pair of frames needs transform_position")
    ra, dec = F.radians(position["ra"]), F.radians(position["dec"])
    xyz = (F.cos(dec) * F.cos(ra), F.cos(dec) * F.sin(ra), F.sin(dec))
    out = [sum((float(matrix[i][j]) * xyz[j] for j in range(1, 3)), float(matrix[i][0]) * xyz[0])
           for i in range(3)]
    return F.struct(vector_ra(out[0], out[1]).alias("ra"), vector_dec(*out).alias("dec"))


def rotate_vertices(vertices, source: Frame, target: Frame) -> Column:
    """A polygon in another frame."""
    return F.transform(vertices, lambda v: rotate_position(v, source, target))


def rotate_circle(circle, source: Frame, target: Frame) -> Column:
    """A circle in another frame; the radius stays."""
    center = rotate_position(circle, source, target)
    return F.struct(center["ra"].alias("ra"), center["dec"].alias("dec"), circle["radius"].alias("radius"))


# frames of the query dialect; FK5 counts as ICRS there
COMPATIBLE = frozenset(["UNKNOWN", "UNKNOWNFRAME", "BARYCENTER", ""])
DIALECT_FRAMES = {"ICRS": FK5, "FK5": FK5, "FK4": FK4, "GALACTIC": GALACTIC, "J2000": FK5, "B1950": FK4,
                  "ECLIPTIC": ecliptic()}


def dialect_rotation(source: str, target: str) -> np.ndarray | None:
    """Matrix for implicit frame changes between geometries; None where nothing has to be done.

    Elliptic terms are left out, as is usual for region tests.
    """
    source, target = (source or "").upper(), (target or "").upper()
    if source in COMPATIBLE or target in COMPATIBLE:
        return None
    for name in (source, target):
        if name not in DIALECT_FRAMES:
            raise ValueError(f"unknown reference frame {name}")
    a, b = DIALECT_FRAMES[source], DIALECT_FRAMES[target]
    if a == b:
        return None
    steps = _chain(a, b)
    if not any(isinstance(s, str) for s in steps):
        return steps[0][:3, :3]
    total = np.eye(3)
    for step in steps:
        if isinstance(step, str):
            part = FK4_TO_FK5[:3, :3] if step == "fk4" else FK5_TO_FK4[:3, :3]
        else:
            part = step[:3, :3]
        total = part @ total
    left, _, right = np.linalg.svd(total)
    return left @ right


SIX_FIELDS = ("ra", "dec", "parallax", "pm_ra", "pm_dec", "rv")


def transform_six(df: DataFrame, source: Frame, target: Frame, columns=SIX_FIELDS, prefix: str = "out_",
                  sla: bool = False) -> DataFrame:
    """Adds position, parallax (arcsec), proper motion (rad/yr, without cos(dec)) and radial velocity
    (km/s) in another frame, each name with ``prefix``.
    """
    ra, dec, parallax, pm_ra, pm_dec, rv = map(num, columns)
    ra, dec = F.radians(ra), F.radians(dec)
    per_century = 100.0 / ARCSEC
    k = AU_PER_CENTURY_SLA if sla or target.name == "FK4" else AU_PER_CENTURY
    x, y, z, u, v, w = _STATE
    df = df.withColumns({
        x: F.cos(dec) * F.cos(ra), y: F.cos(dec) * F.sin(ra), z: F.sin(dec),
        "__pa": pm_ra * per_century, "__pd": pm_dec * per_century, "__rad": k * rv * parallax,
        "__prlx": parallax, "__rv": rv})
    df = df.withColumns({
        u: -F.col("__pa") * F.col(y) - F.col("__pd") * F.cos(ra) * F.col(z) + F.col("__rad") * F.col(x),
        v: F.col("__pa") * F.col(x) - F.col("__pd") * F.sin(ra) * F.col(z) + F.col("__rad") * F.col(y),
        w: F.col("__pd") * F.cos(dec) + F.col("__rad") * F.col(z)})
    df = _run_chain(df, _chain(source, target), sla)
    c = F.col
    df = df.withColumns({
        "__a2": c(x) * c(x) + c(y) * c(y),
        "__xv": c(x) * c(u) + c(y) * c(v)})
    df = df.withColumns({
        "__r2": c("__a2") + c(z) * c(z),
        f"{prefix}pm_ra": F.when(c("__a2") > 0, (c(x) * c(v) - c(y) * c(u)) / c("__a2")) / per_century})
    near = F.abs(c("__prlx")) > 1e-7
    df = df.withColumns({
        f"{prefix}ra": vector_ra(x, y),
        f"{prefix}dec": vector_dec(x, y, z),
        f"{prefix}parallax": F.when(near, c("__prlx") / F.sqrt(c("__r2"))).otherwise(c("__prlx")),
        f"{prefix}pm_dec": F.when(c("__a2") > 0, (c(w) * c("__a2") - c(z) * c("__xv"))
                                  / (c("__r2") * F.sqrt(c("__a2")))) / per_century,
        f"{prefix}rv": F.when(near, (c("__xv") + c(z) * c(w)) / (k * c("__prlx") * F.sqrt(c("__r2"))))
        .otherwise(c("__rv"))})
    return df.drop(*_STATE, "__pa", "__pd", "__rad", "__prlx", "__rv", "__a2", "__xv", "__r2")
