"""Names, rates, selectors and units as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

GENERIC = ("camera", "image_raw", "image", "compressed", "raw", "color", "rgb")
CONVERSIONS = {"rad2deg": F.degrees, "deg2rad": F.radians}


def slug(topic: Column) -> Column:
    """A topic's name in [a-z0-9_]: generic segments go unless nothing else is left."""
    parts = F.filter(F.split(F.lower(topic), "/"), lambda s: s != "")
    named = F.filter(parts, lambda s: ~s.isin(*GENERIC))
    joined = F.array_join(F.when(F.size(named) > 0, named).otherwise(parts), "_")
    return F.regexp_replace(F.regexp_replace(joined, "[^a-z0-9_]+", "_"), "^_+|_+$", "")


def rate(text: Column) -> Column:
    """'num/den' to frames a second; null for anything that isn't a finite positive rate."""
    parts = F.split(text, "/")
    num, den = F.try_element_at(parts, F.lit(1)), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("1"))
    value = F.try_divide(num.try_cast("double"), den.try_cast("double"))
    return F.when((value > 0) & (value < float("inf")), value)


def convert(value: Column, unit: str | float | None) -> Column:
    """A factor, rad2deg or deg2rad; an unknown name changes nothing. The result is float."""
    if unit is None:
        return value.cast("float")
    if isinstance(unit, (int, float)):
        return (value * F.lit(float(unit))).cast("float")
    return CONVERSIONS.get(unit, lambda v: v)(value).cast("float")


def select(vector: Column, selector: str, names: Column | None = None) -> Column:
    """`field[2]`, `field[-1]`, `field.*`, `field.<name>` or `field` over a vector; a missing element is null."""
    if m := re.fullmatch(r"\w+\[(-?\d+)\]", selector):
        k = int(m[1])
        return F.array(F.try_element_at(vector, F.lit(k + 1 if k >= 0 else k)))
    head, _, name = selector.partition(".")
    if name in ("", "*"):
        return vector
    if names is None:
        raise ValueError(f"{selector}: the field has no names")
    place = F.array_position(names, name).cast("int")
    return F.array(F.when(place > 0, F.try_element_at(vector, F.greatest(place, F.lit(1)))))


def pad(vector: Column, width: int) -> Column:
    """Zeros at the end up to the width."""
    return F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), F.lit(width) - F.size(vector))))


def merged(parts: list[tuple[Column, int]]) -> Column:
    """Vectors one after the other; a missing one is zeros of its width."""
    return F.concat(*[F.coalesce(c, F.array_repeat(F.lit(0.0).cast("float"), w)) for c, w in parts])
