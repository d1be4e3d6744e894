"""Text normalisation that stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(c: Column | str) -> Column:
    """Outer white space removed, inner runs made one space (white space as Unicode has it)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(c, r"(?U)[\s​﻿]+", " "))


def norm_id(c: Column | str) -> Column:
    """An id without outer blanks, in lower case; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def norm_name(c: Column | str) -> Column:
    """A name in lower case with its white space squeezed; null where nothing is left."""
    return F.nullif(F.lower(squeeze(c)), F.lit(""))
