"""Regions written as simple space-coordinate text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import regions
from ._args import col
from .regions import Combination, Shape

# fixed values: words that may stand between a shape and its numbers
FRAMES = ("ICRS", "FK5", "FK4", "GALACTIC", "J2000", "B1950", "ECLIPTIC", "UNKNOWNFRAME")
REFERENCE_POSITIONS = ("BARYCENTER", "GEOCENTER", "HELIOCENTER", "LSR", "TOPOCENTER", "RELOCATABLE",
                       "UNKNOWNREFPOS")
FLAVORS = ("CARTESIAN2", "CARTESIAN3", "SPHERICAL2")
# fixed values: how many numbers a shape takes
NUMBER_COUNTS = {"position": 2, "circle": 3, "box": 4}

_WORD = re.compile(r"\s*([A-Za-z][A-Za-z0-9]*)")
_VALUE = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?=[\s()]|$)")


class RegionError(ValueError):
    """Text that is no region."""


def _system(text: str, at: int) -> tuple[str, int]:
    frame = "UNKNOWN"
    while True:
        match = _WORD.match(text, at)
        word = match and match.group(1).upper()
        if word in FRAMES:
            frame = "UNKNOWN" if word == "UNKNOWNFRAME" else word
        elif word in FLAVORS:
            if word != "SPHERICAL2":
                raise RegionError("only SPHERICAL2 regions are understood")
        elif word not in REFERENCE_POSITIONS:
            return frame, at
        at = match.end()


def _expect(text: str, at: int, sign: str) -> int:
    match = re.compile(rf"\s*{re.escape(sign)}").match(text, at)
    if not match:
        raise RegionError(f"expected {sign} at {at} in {text!r}")
    return match.end()


def _region(text: str, at: int):
    match = _WORD.match(text, at)
    if not match:
        raise RegionError(f"no shape at {at} in {text!r}")
    word, at = match.group(1), match.end()
    if word.upper() == "NOT":
        part, at = _region(text, _expect(text, at, "("))
        return Combination("NOT", (part,)), _expect(text, at, ")")
    if word.upper() in ("UNION", "INTERSECTION", "DIFFERENCE"):
        _, at = _system(text, at)
        at, parts = _expect(text, at, "("), []
        while not re.compile(r"\s*\)").match(text, at):
            part, at = _region(text, at)
            parts.append(part)
        if len(parts) < 2:
            raise RegionError(f"{word} needs two regions")
        return Combination(word.upper(), tuple(parts)), _expect(text, at, ")")
    kind = word.lower()
    if kind not in ("position", "circle", "box", "polygon"):
        raise RegionError(f"unknown shape {word}")
    frame, at = _system(text, at)
    numbers = []
    while (value := _VALUE.match(text, at)) is not None:
        numbers.append(float(value.group(1)))
        at = value.end()
    wanted = NUMBER_COUNTS.get(kind)
    if wanted is not None and len(numbers) != wanted or kind == "polygon" and (
            len(numbers) < 6 or len(numbers) % 2):
        raise RegionError(f"wrong number of coordinates for a {kind}")
    return Shape(kind, tuple(numbers), frame), at


def parse_region(text: str | None):
    """A Shape or Combination; None for blank text."""
    if text is None or not text.strip():
        return None
    region, at = _region(text, 0)
    if text[at:].strip():
        raise RegionError(f"junk after the region: {text[at:]!r}")
    return region


def parse_search_shape(text: str) -> Shape:
    """CIRCLE, RANGE or POLYGON of the image search protocol; ranges are Shapes of kind 'range'."""
    match = re.match(r"(CIRCLE|RANGE|POLYGON) (.*)", text)
    if not match:
        raise RegionError(f"no search shape: {text!r}")
    try:
        numbers = tuple(float(n) for n in match.group(2).split())
    except ValueError:
        raise RegionError(f"bad number in {text!r}") from None
    kind = match.group(1).lower()
    if kind == "circle" and len(numbers) != 3 or kind == "range" and len(numbers) != 4 or (
            kind == "polygon" and (len(numbers) < 6 or len(numbers) % 2)):
        raise RegionError(f"wrong number of coordinates in {text!r}")
    if kind == "range" and (numbers[0] > numbers[1] or numbers[2] > numbers[3]):
        raise RegionError(f"lower limits exceed upper limits in {text!r}")
    return Shape(kind, numbers, "ICRS")


# the first maker that knows what to do with a text wins
REGION_MAKERS = [parse_region]


def register_region_maker(maker) -> None:
    """Puts a function from text to a region (or None) in front of the others."""
    REGION_MAKERS.insert(0, maker)


def make_region(text: str):
    for maker in REGION_MAKERS:
        region = maker(text)
        if region is not None:
            return region
    raise RegionError(f"no region maker understands {text!r}")


_NUMBERS = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_HEAD = r"(?i)^\s*(position|circle|box|polygon)\s+(?:[a-z][a-z0-9]*\s+)*"


def region_kind(text) -> Column:
    """The lower-case shape name of simple region texts, NULL for anything else."""
    text = col(text)
    whole = _HEAD + rf"{_NUMBERS}(?:\s+{_NUMBERS})*\s*$"
    return F.when(text.rlike(whole), F.lower(F.regexp_extract(text, _HEAD, 1)))


def region_numbers(text) -> Column:
    """The numbers of a simple region text as an array."""
    tail = F.regexp_replace(col(text), _HEAD, "")
    return F.transform(F.split(F.trim(tail), r"\s+"), lambda t: t.try_cast("double"))


def region_polygon(text) -> Column:
    """A text column of circles, boxes and polygons as polygons; other texts give NULL."""
    parsed = F.struct(region_kind(text).alias("kind"), region_numbers(text).alias("n"))

    def build(s):
        kind, n = s["kind"], s["n"]
        count = F.size(n)
        at = lambda i: F.get(n, F.lit(i))
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(count / 2).cast("int") - 1)),
                            lambda i: F.struct(F.get(n, 2 * i).alias("ra"), F.get(n, 2 * i + 1).alias("dec")))
        return (
            F.when((kind == "circle") & (count == 3), regions.circle_to_polygon(regions.circle(at(0), at(1), at(2))))
            .when((kind == "box") & (count == 4), regions.box(at(0), at(1), at(2), at(3)))
            .when((kind == "polygon") & (count >= 6) & (count % 2 == 0), pairs))

    return regions._bind(parsed, build)
