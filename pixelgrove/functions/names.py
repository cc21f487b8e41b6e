"""File names that any system takes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device names.
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]
_ALNUM = r"\p{IsAlphabetic}\p{N}"


def file_name_of(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def is_reserved(name: Column) -> Column:
    """Of the part before the first dot, whatever its case and trailing spaces."""
    return F.upper(F.regexp_replace(F.substring_index(name, ".", 1), r"[ .]+$", "")).isin(RESERVED)


def sanitise_stem(name: Column) -> Column:
    """The last path segment without its extension; odd characters become dashes; 64 characters."""
    stem = F.regexp_replace(file_name_of(name), r"\.[^.]*$", "")
    clean = F.regexp_replace(stem, rf"[^{_ALNUM}_ -]", "-")
    trimmed = F.regexp_replace(clean, r"^[- .]+|[- .]+$", "")
    capped = F.substring(trimmed, 1, 64)
    return F.when(trimmed == "", "image").when(is_reserved(capped), F.concat(F.lit("_"), capped)).otherwise(capped)


def sanitise_component(name: Column) -> Column:
    """For archive entries: odd characters go, runs of dots become one, 96 characters."""
    clean = F.regexp_replace(file_name_of(name), rf"[^{_ALNUM}_.-]", "")
    capped = F.substring(F.regexp_replace(clean, r"\.+", "."), 1, 96)
    trimmed = F.regexp_replace(capped, r"^\.+|\.+$", "")
    return F.when(trimmed == "", "file").when(is_reserved(trimmed), F.concat(F.lit("_"), trimmed)).otherwise(trimmed)


def output_name(name: Column, extension: Column) -> Column:
    return F.concat(sanitise_stem(name), F.lit("."), extension)
