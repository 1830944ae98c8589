"""Reading open-ended nested columns (variants)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_str(value: Column, path: str) -> Column:
    """The string at ``path`` of a variant, NULL where there is none."""
    return F.try_variant_get(value, path, "string")


def tag_list(value: Column, path: str = "$.key_value") -> Column:
    """The list of key and value pairs at ``path`` of a variant, NULL where there is none."""
    return F.try_variant_get(value, path, "array<struct<key:string,value:string>>")


def match_any(value: Column, patterns: list[str]) -> Column:
    """True where ``value`` matches one of the patterns, whatever its case."""
    return reduce(or_, [value.ilike(p) for p in patterns])
