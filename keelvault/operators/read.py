"""Reading the vault."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelvault.operators.stage import LDTS


def current_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The latest row of each key by load time; ties go to the largest remaining values."""
    others = [c for c in df.columns if c not in (*keys, LDTS)]
    last = df.groupBy(*keys).agg(F.max(F.struct(LDTS, *others)).alias("x"))
    return last.select(*keys, *[F.col(f"x.{c}").alias(c) for c in (LDTS, *others)])


def relationship_history(eff: DataFrame, hubs: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Effectivity with the business keys of its hubs ({foreign key: (hub, hub key, business key)}). The
    order (by driving key and start, say) is the caller's."""
    out = eff
    for fk, (hub, pk, nk) in hubs.items():
        out = out.join(hub.select(F.col(pk).alias(fk), nk), fk)
    names = [nk for _, _, nk in hubs.values()]
    return out.select(*names, "START_DATE", "END_DATE", LDTS)


def vault_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each vault table."""
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)


def hub_feed_membership(hub: DataFrame, sats: Mapping[str, DataFrame], pk: str) -> DataFrame:
    """Each key with the feeds that have a satellite row for it: one name, or several joined by ``+``."""
    out = hub
    flags = []
    for feed, sat in sats.items():
        out = out.join(sat.select(pk).distinct().withColumn(f"_kv_{feed}", F.lit(feed)), pk, "left")
        flags.append(F.col(f"_kv_{feed}"))
    return out.select(*hub.columns, F.coalesce(F.nullif(F.concat_ws("+", *flags), F.lit("")), F.lit("none")).alias("feeds"))
