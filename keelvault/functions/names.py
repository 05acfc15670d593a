"""Identifiers and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_identifier(c: Column | str) -> Column:
    """Runs of other characters than ASCII letters and digits as one underscore, none at the ends, upper case."""
    return F.upper(F.btrim(F.regexp_replace(_col(c), "[^0-9a-zA-Z]+", "_"), F.lit("_")))


def tokens(c: Column | str, least: int = 2, stop: tuple[str, ...] = ()) -> Column:
    """Distinct tokens of an identifier or label: parts of its normal form of at least ``least`` characters."""
    parts = F.split(normalize_identifier(c), "_")
    kept = F.filter(parts, lambda t: (F.length(t) >= least) & (~t.isin(*stop) if stop else F.lit(True)))
    return F.array_distinct(kept)
