"""Values: sizes, digests, templates, arguments and attributes."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Binary size units above the byte.
SIZE_UNITS = ("KiB", "MiB", "GiB", "TiB", "PiB")

# Opening and closing text of a placeholder, by template style.
TEMPLATE_STYLES = {"braces": ("{{", "}}"), "hash": ("#{", "}")}


def format_bytes(size: Column) -> Column:
    """Human-readable size; null reads ``unknown``, nothing exceeds PiB.

    One decimal, ties to even: ``format_string`` alone would round them up.
    """
    value, unit = size / float(1024 ** len(SIZE_UNITS)), F.lit(SIZE_UNITS[-1])
    for power, name in reversed(list(enumerate(SIZE_UNITS[:-1], start=1))):
        below = size < 1024 ** (power + 1)
        value = F.when(below, size / float(1024**power)).otherwise(value)
        unit = F.when(below, name).otherwise(unit)
    scaled = F.concat(F.format_string("%.1f", F.bround(value, 1)), F.lit(" "), unit)
    return (
        F.when(size.isNull(), "unknown")
        .when(size < 1024, F.concat(size.cast("bigint").cast("string"), F.lit(" B")))
        .otherwise(scaled)
    )


def digest(content: Column, algo: Column) -> Column:
    """Lower-case hex digest by the row's own algorithm, null for others."""
    name = F.lower(algo)
    return F.when(name == "sha256", F.sha2(content, 256)).when(
        name == "sha512", F.sha2(content, 512)
    )


def render_template(template: Column, args: Column, style: str) -> Column:
    """Fill ``{{name}}`` (style ``braces``) or ``#{name}`` (``hash``).

    Unknown names stay. The text is read once, so a value that itself holds a
    placeholder is not filled again and the order of the map has no effect.
    """
    opening, closing = TEMPLATE_STYLES[style]
    first = re.escape(opening[0])
    slot = rf"{re.escape(opening)}([^{{}}]+){re.escape(closing)}"
    pieces = F.regexp_extract_all(template, F.lit(rf"(?s){slot}|[^{first}]+|{first}"), F.lit(0))
    name = lambda piece: F.regexp_extract(piece, rf"^{slot}$", 1)
    return F.array_join(
        F.transform(pieces, lambda p: F.coalesce(F.element_at(args, name(p)), p)), ""
    )


def resolve_args(defaults: Column, overrides: Column) -> Column:
    """Declared defaults overlaid by the overrides that hold a value."""
    nothing = F.create_map().cast("map<string,string>")
    return F.map_zip_with(
        F.coalesce(defaults, nothing),
        F.coalesce(overrides, nothing),
        lambda _, default, override: F.coalesce(override, default),
    )


def supports(platforms: Column, platform: str) -> Column:
    """Whether a test runs on a platform; false if it names none."""
    return F.coalesce(F.array_contains(platforms, platform), F.lit(False))


def has_value(row: Column, key: str) -> Column:
    """Whether a variant row holds the key with neither null nor empty text."""
    return F.coalesce(F.try_variant_get(row, f"$.{key}", "string") != "", F.lit(False))


def matches_attrs(attrs: Column, row: Column) -> Column:
    """Whether every attribute equals the row map's field (null equals null)."""
    return F.forall(
        F.map_entries(attrs), lambda e: e["value"].eqNullSafe(F.element_at(row, e["key"]))
    )


def with_defaults(df: DataFrame, defaults: dict[str, Any]) -> DataFrame:
    """Fill missing values with the documented defaults."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
