"""A vault as a declared plan: hubs, links and satellites over named stages, loaded batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelvault.operators import load as loads
from keelvault.operators.stage import LDTS, SOURCE, Staged, role_hash
from keelvault.sources.feeds import PACKED, shared_folder, written


#: Parts of a kind that are loaded at a time, and buckets of a small table.
TOGETHER, BUCKETS = 4, 8


@dataclass(frozen=True)
class Hub:
    name: str
    stages: Sequence[str]
    pk: str
    nk: str


@dataclass(frozen=True)
class Link:
    """A link, or with ``event_time`` a transactional link with payload.

    ``roles`` (hub, role, key column) add the foreign keys ``<HUB>_<ROLE>_HK`` of hubs that take part
    in a role; ``degenerate_key`` names what tells events of the same participations apart."""

    name: str
    stage: str
    pk: str
    fks: Sequence[str]
    keys: Sequence[str] = ()
    event_time: str | None = None
    payload: Sequence[str] = ()
    degenerate_key: Sequence[str] = ()
    roles: Sequence[tuple[str, str, str]] = ()


@dataclass(frozen=True)
class Satellite:
    """A satellite of kind standard, multi_active (with child keys) or effectivity (with driving and
    secondary keys)."""

    name: str
    stage: str
    pk: str
    hashdiff: str = "HASHDIFF"
    payload: Sequence[str] = ()
    kind: str = "standard"
    child_keys: Sequence[str] = ()
    driving: Sequence[str] = ()
    secondary: Sequence[str] = ()


@dataclass(frozen=True)
class VaultSpec:
    hubs: Sequence[Hub] = field(default_factory=tuple)
    links: Sequence[Link] = field(default_factory=tuple)
    satellites: Sequence[Satellite] = field(default_factory=tuple)


def new_rows(part: Hub | Link | Satellite, stages: Mapping[str, DataFrame | Staged], target: DataFrame | None, parts: int | None = None) -> DataFrame:
    """What a part takes of a batch. Rows of a ``Staged`` are exchanged into ``parts`` parts before they are
    hashed, but those of hubs, which are combined first, and where the plan makes or exchanges another key."""
    if isinstance(part, Hub):
        return loads.load_hub([_rows(stages[s]) for s in part.stages], target, part.pk, part.nk)
    stage = stages[part.stage]
    if isinstance(part, Satellite) and part.kind == "multi_active":
        held = None if target is None else target.count()  # of a stored table, from its footers
        return loads.load_ma_sat(stage, target, part.pk, part.child_keys, part.hashdiff, part.payload, parts=parts, target_rows=held)
    if isinstance(part, Link):
        for role in part.roles:
            stage = stage.then(lambda df, role=role: role_hash(df, *role)) if isinstance(stage, Staged) else role_hash(stage, *role)
        if part.event_time:
            return loads.load_t_link(stage, target, part.pk, part.fks, part.payload, part.event_time, part.degenerate_key, parts)
        return loads.load_link(stage, target, part.pk, part.fks, part.keys, parts)
    if part.kind == "effectivity":
        return loads.load_eff_sat(_rows(stage), target, part.pk, part.driving, part.secondary)
    stage = stage.rows(part.pk, parts) if isinstance(stage, Staged) else stage
    return loads.load_sat(stage, target, part.pk, part.hashdiff, part.payload)


def buckets_for(rows: int) -> int:
    """Buckets for a table of so many rows: as many rows in each as one task is to hash and sort."""
    return max(BUCKETS, -(-rows // loads.TASK_ROWS))


def _rows(stage: DataFrame | Staged) -> DataFrame:
    return stage.rows() if isinstance(stage, Staged) else stage


def load_vault(spark: SparkSession, spec: VaultSpec, stages: Mapping[str, DataFrame | Staged], path: str) -> dict[str, str]:
    """Load one batch into the tables below ``path``, hubs first, then links, then satellites; each
    table is written before the next is read, and the same batch again adds nothing.

    A stage that several tables read is written to the shared folder first, so it is made once and a
    lost executor costs a re-read only; but a ``Staged`` is not, since its relation is stored already."""
    paths = {part.name: f"{path}/{part.name}" for part in _parts(spec)}

    def held(part) -> DataFrame | None:
        try:
            return spark.read.parquet(paths[part.name])
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    _load(spec, stages, held, lambda part, rows: rows.write.option("compression", PACKED).mode("append").parquet(paths[part.name]))
    return paths


def load_bucketed_vault(spark: SparkSession, spec: VaultSpec, stages: Mapping[str, DataFrame | Staged], database: str, buckets: int | Mapping[str, int]) -> dict[str, str]:
    """As ``load_vault``, into tables of the catalog that are bucketed by their hash keys.

    A batch then meets a table without an exchange of the table: only the batch is shuffled, however
    much is loaded already, and rows of a ``Staged`` once, without their hashes. Each load adds a file a bucket.
    ``buckets``, for all tables or by name, stays as it is over the life of a table, so choose it for the size
    that the table will have (``buckets_for``): a bucket of a batch is one task's work."""
    of = (lambda part: buckets) if isinstance(buckets, int) else (lambda part: buckets[part.name])
    names = {part.name: f"{database}.{part.name}" for part in _parts(spec)}

    def held(part) -> DataFrame | None:
        return spark.table(names[part.name]) if spark.catalog.tableExists(names[part.name]) else None

    def add(part, rows: DataFrame) -> None:
        rows.repartition(of(part), part.pk).write.option("compression", PACKED).mode("append").format("parquet").bucketBy(of(part), part.pk).sortBy(part.pk).saveAsTable(names[part.name])

    _load(spec, stages, held, add, of)
    return names


def compact_bucketed(spark: SparkSession, table: str, buckets: int, pk: str) -> None:
    """Rewrite a bucketed table with one sorted file a bucket. After many loads a bucket has a file of each,
    and then its order is no longer known.

    The new table takes the old one's place when it is whole; a run that was broken off is completed by
    the next one. With ``spark.sql.legacy.bucketedTableScan.outputOrdering`` Spark then joins the
    table by its key without an exchange and without a sort."""
    new, old = f"{table}_compacted", f"{table}_replaced"
    if spark.catalog.tableExists(table):
        spark.sql(f"DROP TABLE IF EXISTS {new}")
        setting, held = "spark.sql.sources.bucketing.enabled", spark.conf.get("spark.sql.sources.bucketing.enabled")
        spark.conf.set(setting, "false")  # else the exchange that gathers a bucket's files is left out
        try:
            spark.table(table).repartition(buckets, pk).write.option("compression", PACKED).format("parquet").bucketBy(buckets, pk).sortBy(pk).saveAsTable(new)
        finally:
            spark.conf.set(setting, held)
        spark.sql(f"DROP TABLE IF EXISTS {old}")
        spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {new} RENAME TO {table}")
    spark.sql(f"DROP TABLE IF EXISTS {old}")


def _parts(spec: VaultSpec) -> tuple:
    return (*spec.hubs, *spec.links, *spec.satellites)


def _used(spec: VaultSpec, stage: str, columns: Sequence[str]) -> list[str]:
    """The columns of a stage that the parts of a plan read, in their order."""
    used = {LDTS, SOURCE, "START_DATE"}
    for hub in spec.hubs:
        used |= {hub.pk, hub.nk} if stage in hub.stages else set()
    for link in spec.links:
        if link.stage == stage:
            used |= {link.pk, *link.fks, *link.keys, *link.payload, *link.degenerate_key, *(key for _, _, key in link.roles)} | ({link.event_time} if link.event_time else set())
    for sat in spec.satellites:
        if sat.stage == stage:
            used |= {sat.pk, sat.hashdiff, *sat.payload, *sat.child_keys, *sat.driving, *sat.secondary}
    return [c for c in columns if c.lower() in {u.lower() for u in used}]


def _load(spec: VaultSpec, stages: Mapping[str, DataFrame | Staged], held: Callable, add: Callable, buckets: Callable = lambda part: None) -> None:
    """Load one batch: ``held`` gives what a table has, or None, and ``add`` appends to it. Parts of a kind
    don't read each other and are loaded together; if one fails, what the others have loaded stays, and
    the same batch again completes the load."""
    users: dict[str, int] = {}
    for part in _parts(spec):
        for s in part.stages if isinstance(part, Hub) else [part.stage]:
            users[s] = users.get(s, 0) + 1
    shared = {n: written(df.select(*_used(spec, n, df.columns)), n) if users.get(n, 0) > 1 and not isinstance(df, Staged) else df for n, df in stages.items()}
    for kind in (spec.hubs, spec.links, spec.satellites):
        with ThreadPoolExecutor(max_workers=TOGETHER) as pool:  # Spark runs the jobs of several threads side by side
            list(pool.map(inheritable_thread_target(lambda part: add(part, new_rows(part, shared, held(part), buckets(part)))), kind))


def run_batches(stage: DataFrame | Staged, cuts: Sequence[str], load: Callable[[DataFrame | Staged, DataFrame | None], DataFrame], ldts: str = LDTS) -> DataFrame:
    """The table after loading the parts of a stage between load times ``cuts``, one after another.

    Every batch is appended to a table in the shared folder before the next one reads it."""
    spark = (stage.df if isinstance(stage, Staged) else stage).sparkSession
    path = f"{shared_folder(spark)}/table"
    target = None
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:], strict=False):
        batch = stage
        if low is not None:
            batch = batch.where(F.col(ldts) >= F.lit(low).cast("timestamp"))
        if high is not None:
            batch = batch.where(F.col(ldts) < F.lit(high).cast("timestamp"))
        rows = load(batch, target)
        rows.write.option("compression", PACKED).mode("append").parquet(path)
        target = spark.read.schema(rows.schema).parquet(path)
    return target
