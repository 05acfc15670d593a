"""Staging: derived columns, canonical keys and hashes, in one projection."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelvault.functions.hashing import hash_key, hashdiff

LDTS, SOURCE = "LOAD_DATETIME", "RECORD_SOURCE"


def derive(df: DataFrame, derived: Mapping[str, Column | str]) -> DataFrame:
    """Derived columns: {new name: source column or expression}."""
    return df.withColumns({n: F.col(c) if isinstance(c, str) else c for n, c in derived.items()})


def role_hash(df: DataFrame, hub: str, role: str, key: str) -> DataFrame:
    """Foreign key of a hub in a role: ``<HUB>_<ROLE>_HK`` from the role's key column."""
    return df.withColumn(f"{hub}_{role}_HK".upper(), hash_key([key]))


def canonical_key(df: DataFrame, hub: str, feed_column: str, feed_columns: Sequence[str] = ()) -> DataFrame:
    """A feed's key under its canonical name: the feed's own where all feeds agree, else ``<HUB>_ID``."""
    name = feed_column if len({*feed_columns, feed_column}) == 1 else f"{hub}_ID".upper()
    return df.withColumn(name, F.col(feed_column))


def alias_fk(df: DataFrame, hub_key: str, source_column: str) -> DataFrame:
    """A renamed foreign key under the name of the hub's key, hashed as the hub hashes it."""
    return df.withColumn(hub_key, F.col(source_column)).withColumn(f"{hub_key}_HK".upper(), hash_key([hub_key]))


def stage_finer_grain(child: DataFrame, parent_hk: str, parent_keys: Sequence[str]) -> DataFrame:
    """Rows of a finer relation with the parent's hash key."""
    return child.withColumn(parent_hk, hash_key(parent_keys))


def with_load_metadata(df: DataFrame, ldts: Column | str | None = None, source: str | None = None) -> DataFrame:
    """Rows with LOAD_DATETIME and RECORD_SOURCE: given here, or already there (else an error)."""
    new = {}
    if ldts is not None:
        new[LDTS] = F.col(ldts) if isinstance(ldts, str) else ldts
    if source is not None:
        new[SOURCE] = F.lit(source)
    missing = {LDTS, SOURCE} - set(df.columns) - set(new)
    if missing:
        raise ValueError(f"no {', '.join(sorted(missing))}: give a column or a value")
    return df.withColumns(new)


@dataclass(frozen=True)
class StageSpec:
    """What a stage adds: derived columns, hash keys ({name: key columns}) and hashdiffs ({name: payload})."""

    derived: Mapping[str, Column | str] = field(default_factory=dict)
    keys: Mapping[str, Sequence[str]] = field(default_factory=dict)
    diffs: Mapping[str, Sequence[Column | str]] = field(default_factory=dict)
    ldts: Column | str | None = None
    source: str | None = None
    keep: Sequence[str] | None = None


def stage(df: DataFrame, spec: StageSpec, by: str | None = None, parts: int | None = None, held: DataFrame | None = None) -> DataFrame:
    """Source columns, derived columns and all hashes in one projection; the first of equal names wins.

    With ``by`` rows are exchanged by that hash key first, into ``parts`` parts: source values cross the exchange,
    and hashes are made where rows then lie, so a load by that key exchanges its rows no more. Rows of a
    key are not combined before this exchange: for keys with few rows each. Rows whose key ``held`` has are
    left out before the other hashes are made."""
    if spec.keep is not None:
        df = df.select(*spec.keep)
    names = {*df.columns, *spec.derived}
    if by is not None:
        key = hash_key([spec.derived.get(c, c) for c in spec.keys[by]], df)
        df = df.repartition(key) if parts is None else df.repartition(parts, key)
        if held is not None and by not in names:
            df = df.withColumn(by, key).join(held.select(by), by, "left_anti")
    base = with_load_metadata(derive(df, spec.derived), spec.ldts, spec.source)
    hashes = {n: hash_key(c, base) for n, c in spec.keys.items()} | {n: hashdiff(c, base) for n, c in spec.diffs.items() if n not in spec.keys}
    rows = base.select("*", *[c.alias(n) for n, c in hashes.items() if n not in base.columns])
    return rows if held is None or by not in names else rows.join(held.select(by), by, "left_anti")


@dataclass(frozen=True)
class Staged:
    """A stored relation, what a stage adds to it, and steps on the stage, such as conditions: a stage that each
    load exchanges by its own key before hashes are made."""

    df: DataFrame
    spec: StageSpec
    steps: Sequence[Callable[[DataFrame], DataFrame]] = ()

    def where(self, condition: Column | str) -> Staged:
        return self.then(lambda df: df.where(condition))

    def then(self, step: Callable[[DataFrame], DataFrame]) -> Staged:
        """With a step that takes each row by itself, wherever it lies, and keeps the keys."""
        return replace(self, steps=[*self.steps, step])

    def rows(self, by: str | None = None, parts: int | None = None, held: DataFrame | None = None) -> DataFrame:
        """The staged rows, exchanged by a hash key if one is named, without those whose key ``held`` has."""
        return reduce(lambda df, step: step(df), self.steps, stage(self.df, self.spec, by, parts, held))
