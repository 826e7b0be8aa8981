"""Named queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tellerlake.session import use_utc
from tellerlake.standin import Bank


@dataclass(frozen=True)
class Entry:
    run: Callable[[Bank], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(bank) -> DataFrame` under `name`; `sql` is the independent oracle."""

    def register(fn):
        if name in ENTRIES:
            raise ValueError(f"Query {name} is registered twice")
        ENTRIES[name] = Entry(fn, sql)
        return fn

    return register


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return ENTRIES[name].run(Bank(use_utc(spark), sf_dir))


def load_all() -> dict[str, Entry]:
    import importlib
    import pkgutil

    import tellerlake.catalog as catalog

    for module in pkgutil.iter_modules(catalog.__path__):
        importlib.import_module(f"tellerlake.catalog.{module.name}")
    return ENTRIES
