"""Numbers and names as report text, as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int) -> Column:
    """A number with so many digits after the point."""
    return F.regexp_replace(F.format_number(x, digits), ",", "")


def grouped(x: Column, digits: int = 0) -> Column:
    """The same with commas between thousands."""
    return F.format_number(x, digits)


def short_number(x: Column) -> Column:
    """A number of few digits without trailing zeros: 0.05, 0.9, 1."""
    return F.regexp_replace(x.cast("double").cast("string"), r"\.0$", "")


def without_suffix(name: Column, suffix: str) -> Column:
    """A name without the suffix, if it ends with it."""
    return F.regexp_replace(name, f"{re.escape(suffix)}$", "")


def heading(name: Column) -> Column:
    """A column's name as words: blanks for underscores, the first letter large, the rest small."""
    words = F.lower(F.replace(name, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def from_template(template: str, **values: Column) -> Column:
    """A template such as ``…/{year}.xlsx`` with its named places filled."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])
