"""Raw text to contract types: bad values become NULL and can be counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerlake.contract import VALUE_ALIASES, Table

# Fixed spellings of the source's boolean columns.
TRUE_WORDS = ("true", "1", "t", "yes", "y", "si", "sí")
FALSE_WORDS = ("false", "0", "f", "no", "n")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def lenient_boolean(c: Column) -> Column:
    word = F.lower(blank_to_null(c))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def lenient_int(c: Column) -> Column:
    """'3.0' is 3, 'x' is NULL."""
    return blank_to_null(c).try_cast("decimal(38,6)").try_cast("int")


def normalise_alias(c: Column, aliases: dict[str, str]) -> Column:
    value = blank_to_null(c)
    out = F.when(F.lit(False), value)
    for spelling, canonical in aliases.items():
        out = out.when(value == spelling, F.lit(canonical))
    return out.otherwise(value)


def typed(c: Column, type_: str, aliases: dict[str, str] | None = None) -> Column:
    if type_ == "STRING":
        return normalise_alias(c, aliases) if aliases else blank_to_null(c)
    if type_ == "BOOLEAN":
        return lenient_boolean(c)
    if type_ == "INT":
        return lenient_int(c)
    return blank_to_null(c).try_cast(type_)


def apply_contract(raw: DataFrame, table: Table, keep_raw: bool = False) -> DataFrame:
    """Contract columns in their types (absent ones NULL), then unexpected and lineage columns as they came."""
    def source(name: str) -> Column:
        return F.col(f"`{name}`") if name in raw.columns else F.lit(None).cast("string")

    return raw.select(
        *[typed(source(c.name), c.type, VALUE_ALIASES.get(c.name)).alias(c.name) for c in table.columns],
        *[F.col(f"`{c}`") for c in raw.columns if c not in table.names],
        *([source(c.name).alias(f"{c.name}__text") for c in table.columns] if keep_raw else []),
    )
