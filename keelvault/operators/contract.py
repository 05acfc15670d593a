"""Data contracts on rows: one pass of column expressions for all rules of a contract."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelvault.sources.feeds import PHYSICAL

SEMANTICS = ("charLength", "min", "max", "pattern", "isNotEmpty", "isNullThreshold", "format")


@dataclass(frozen=True)
class Semantic:
    """A rule on values: one of SEMANTICS with its value, hard (quarantine) or soft (alert)."""

    kind: str
    value: object = None
    mode: str = "soft"


@dataclass(frozen=True)
class Field:
    """A column of a contract. ``types`` has one or more base types; null among them allows nulls."""

    name: str
    types: Sequence[str] = ("unknown",)
    primary_key: bool = False
    nullable: bool = True
    enum: Sequence[str] = ()
    mode: str = "hard"
    semantics: Sequence[Semantic] = ()

    @property
    def allows_null(self) -> bool:
        return (self.nullable or "null" in self.types) and not self.primary_key


@dataclass(frozen=True)
class Contract:
    fields: Sequence[Field] = field(default_factory=tuple)


def castable(c: Column, types: Sequence[str]) -> Column:
    """Whether a value, as text, fits one of the types, as a drafted contract reads it: 1.5 is no integer.
    Null, unknown and nested types fit always."""
    known = [t for t in types if t in PHYSICAL]
    if not known or "string" in types or any(t not in PHYSICAL and t != "null" for t in types):
        return F.lit(True)
    fits = F.lit(False)
    for t in known:
        fits = fits | read_as(c.cast("string"), t).isNotNull()
    return c.isNull() | fits


#: Patterns of text that may be read as a type, any white space around it, where reading other text fails by an
#: exception for each value, which costs more than all else. A number has no other ASCII signs than these, and
#: no sign after a digit.
MAY_BE = {
    "boolean": r"(?i)^[^!-~]*(t|true|y|yes|1|f|false|n|no|0)[^!-~]*$",
    "integer": r"^[^!-~]*[+-]?[0-9]+[^!-~]*$",
    "number": r"^(?![\s\S]*[0-9.][+-])[^\x21-\x2a,/:-DF-df-~]*$",
}


def read_as(c: Column, kind: str) -> Column:
    """A value as a contract type, null where it doesn't fit; a date has no time of day."""
    read = c.try_cast(PHYSICAL[kind])
    if kind in MAY_BE:
        return F.when(c.cast("string").rlike(MAY_BE[kind]), read)
    return F.when(c.cast("string").rlike(r"^\s*\d+-\d+-\d+\s*$"), read) if kind == "date" else read


def format_ok(c: Column, fmt: str) -> Column:
    """Whether text has the format ``date`` or ``date-time``; null has."""
    return c.isNull() | read_as(c.cast("string"), fmt).isNotNull()


def row_rules(contract: Contract) -> list[tuple[str, str, str, Column]]:
    """(field, rule, mode, breach) for every rule that a single row can break."""
    rules = []
    for f in contract.fields:
        c = F.col(f.name)
        if not f.allows_null:
            rules.append((f.name, "not_null", f.mode, c.isNull()))
        if f.enum:
            rules.append((f.name, "accepted_values", f.mode, F.coalesce(~c.cast("string").isin(*f.enum), F.lit(False))))
        if any(t in PHYSICAL and t != "string" for t in f.types):
            rules.append((f.name, "type", f.mode, ~castable(c, f.types)))
        for s in f.semantics:
            text = c.cast("string")
            breach = {
                "charLength": lambda text=text, s=s: F.length(text) > s.value,
                "min": lambda c=c, s=s: c < F.lit(s.value),
                "max": lambda c=c, s=s: c > F.lit(s.value),
                "pattern": lambda text=text, s=s: ~text.rlike(s.value),
                "isNotEmpty": lambda text=text: F.trim(text) == "",
                "format": lambda c=c, s=s: ~format_ok(c, s.value),
            }.get(s.kind)
            if breach:
                rules.append((f.name, s.kind, s.mode, F.coalesce(breach(), F.lit(False))))
    return rules


def check_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, n_rows): nulls in each column."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_rows")) for c in cols])).alias("x")).select("x.*")


def check_unique(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*cols).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def check_accepted_values(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """Values outside the accepted ones, with their number of rows; null is not a value."""
    return df.where(~F.col(col).isin(*values)).groupBy(col).agg(F.count("*").alias("n_rows"))


def check_types(df: DataFrame, types: Mapping[str, Sequence[str]]) -> DataFrame:
    """(column_name, n_rows): values that fit none of their declared types."""
    one = df.agg(*[F.count_if(~castable(F.col(c), t)).alias(c) for c, t in types.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_rows")) for c in types])).alias("x")).select("x.*")


def check_format(df: DataFrame, col: str, fmt: str) -> DataFrame:
    """Rows whose text lacks the format ``date`` or ``date-time``."""
    return df.where(~format_ok(F.col(col), fmt))


def contract_report(df: DataFrame, contract: Contract) -> DataFrame:
    """(field, rule, mode, n_rows): breaches of every rule, in one pass over the rows; a threshold on
    nulls counts the nulls where their share is above it."""
    rules = row_rules(contract)
    limits = [(f.name, s) for f in contract.fields for s in f.semantics if s.kind == "isNullThreshold"]
    aggs = [F.count_if(b).alias(f"r{i}") for i, (_, _, _, b) in enumerate(rules)] + [F.count("*").alias("n")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"t{i}") for i, (c, _) in enumerate(limits)]
    one = df.agg(*aggs)
    parts = [F.struct(F.lit(f).alias("field"), F.lit(r).alias("rule"), F.lit(m).alias("mode"), F.col(f"r{i}").alias("n_rows")) for i, (f, r, m, _) in enumerate(rules)]
    for i, (c, s) in enumerate(limits):
        over = F.when(F.col(f"t{i}") > F.col("n") * float(s.value), F.col(f"t{i}")).otherwise(F.lit(0))
        parts.append(F.struct(F.lit(c).alias("field"), F.lit(s.kind).alias("rule"), F.lit(s.mode).alias("mode"), over.cast("long").alias("n_rows")))
    return one.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def check_semantics(df: DataFrame, contract: Contract) -> DataFrame:
    """The part of the report on value semantics."""
    return contract_report(df, contract).where(F.col("rule").isin(*SEMANTICS))


def breaches(df: DataFrame, contract: Contract) -> DataFrame:
    """Rows with ``hard`` and ``soft``: the names (field.rule) of the rules that they break."""
    rules = row_rules(contract)

    def broken(mode: str) -> Column:
        names = [F.when(b, F.lit(f"{f}.{r}")) for f, r, m, b in rules if m == mode]
        return F.filter(F.array(*names), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")

    return df.withColumns({"hard": broken("hard"), "soft": broken("soft")})


def route(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(passed, quarantined): rows that break a hard rule are quarantined; those that break only soft
    ones pass with ``soft`` as their alert."""
    marked = breaches(df, contract)
    return marked.where(F.size("hard") == 0).drop("hard"), marked.where(F.size("hard") > 0)


def draft_contract(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(field, data_type, nullable, primary_key) as the data suggest: the narrowest type that all
    values fit, ``unknown`` for a column without values, keys not null."""
    order = ("boolean", "integer", "number", "date", "date-time")
    aggs = []
    for i, c in enumerate(df.columns):
        text = F.col(c).cast("string")
        aggs += [F.count(c).alias(f"n{i}"), F.count_if(F.col(c).isNull()).alias(f"z{i}")]
        aggs += [F.count(read_as(text, t)).alias(f"t{i}_{j}") for j, t in enumerate(order)]
    one = df.agg(*aggs)
    rows = []
    for i, c in enumerate(df.columns):
        kind = F.when(F.col(f"n{i}") == 0, "unknown")
        for j, t in enumerate(order):
            kind = kind.when(F.col(f"t{i}_{j}") == F.col(f"n{i}"), t)
        rows.append(F.struct(F.lit(c).alias("field"), kind.otherwise("string").alias("data_type"), ((F.col(f"z{i}") > 0) & F.lit(c not in keys)).alias("nullable"), F.lit(c in keys).alias("primary_key")))
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
