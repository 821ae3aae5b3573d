"""Path-derived columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))


def parent_name(path: Column) -> Column:
    """Name of the folder holding the file, '' when there is none."""
    return F.coalesce(F.try_element_at(_parts(path), F.lit(-2)), F.lit(""))


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is not a suffix."""
    name = F.coalesce(F.try_element_at(_parts(path), F.lit(-1)), F.lit(""))
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
