"""Names, tokens and defaults as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_tokens(name: Column) -> Column:
    """Lower-case words of a name before its brackets, and what stands in the brackets."""
    words = F.filter(F.split(F.lower(F.trim(F.split(name, r"[()]")[0])), r"[\s\-_,]+"), lambda w: F.length(w) > 0)
    inner = F.lower(F.trim(F.regexp_extract(name, r"\(([^)]+)\)", 1)))
    return F.concat(words, F.when(F.length(inner) > 0, F.array(inner)).otherwise(F.array().cast("array<string>")))


def first_colour(*choices: Column) -> Column:
    """An explicit colour, else the sampled one, else the default."""
    return F.coalesce(*choices)


def derived_seeds(seed: Column) -> Column:
    """Seeds of the four noise layers, each from the one given."""
    base = seed * 100
    return F.array(base + 2, base + 13, base + 25, base + 17)


def style_strength(style: Column, given: Column, defaults: dict[str, float]) -> Column:
    known = F.create_map(*[F.lit(v) for kv in defaults.items() for v in kv])
    return F.coalesce(given, F.element_at(known, style))
