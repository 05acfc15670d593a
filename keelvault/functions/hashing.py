"""Hash keys and hashdiffs: md5 in lower hexadecimal over canonical text, parts joined in declared order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DecimalType, IntegralType

SEPARATOR, MISSING = "||", "^^"


def canonical(c: Column | str, kind: DataType | None = None) -> Column:
    """Trimmed, upper-case text of a value; null and blank values become ``^^``. A backslash goes before
    the characters of the separator and of this mark, so no other list of values has the same text.

    Cast doubles to decimals first: their text form is not stable across engines. Of a ``kind`` whose text has
    no blanks, letters to raise or signs, the text is taken as it is."""
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(kind, (IntegralType, DecimalType, DateType)):
        return F.coalesce(c.cast("string"), F.lit(MISSING))
    text = F.upper(F.trim(c.cast("string")))
    text = F.when(text != "", text)  # not nullif: Spark then knows a key again after an exchange by it
    for sign in ("\\", SEPARATOR[0], MISSING[0]):
        text = F.replace(text, F.lit(sign), F.lit("\\" + sign))
    return F.coalesce(text, F.lit(MISSING))


def is_blank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (F.trim(c.cast("string")) == "")


def hash_key(cols: Sequence[Column | str], of: DataFrame | None = None) -> Column:
    """Key of one or more business keys in declared order. ``of`` may name the relation that has them: the key is
    the same, and numbers and dates are hashed without cleaning their text."""
    kinds = [None] * len(cols) if of is None else [f.dataType for f in of.select(*cols).schema]
    return F.md5(F.concat_ws(SEPARATOR, *[canonical(c, k) for c, k in zip(cols, kinds, strict=True)]).cast("binary"))


def hashdiff(cols: Sequence[Column | str], of: DataFrame | None = None) -> Column:
    """Change-detection hash of a payload; nulls keep their place."""
    return hash_key(cols, of)


def packed(c: str) -> Column:
    """A text as bytes that hold a hash key in half its length; no two texts have the same bytes. For exchanges."""
    raw = F.unhex(c)
    is_hash = (F.length(c) == 32) & (F.lower(F.hex(raw)) == F.col(c))
    return F.when(is_hash, F.concat(F.lit(b"\x00"), raw)).otherwise(F.concat(F.lit(b"\x01"), F.col(c).cast("binary")))


def unpacked(c: Column | str) -> Column:
    """The text that ``packed`` has made bytes of."""
    c = F.col(c) if isinstance(c, str) else c
    rest = F.substr(c, F.lit(2))
    return F.when(F.substr(c, F.lit(1), F.lit(1)) == F.lit(b"\x00"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))
