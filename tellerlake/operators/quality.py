"""Contract checks: one wide aggregate per table, reported as one row per check."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerlake.contract import MAX_CAST_FAILURE_PCT, MAX_DUPLICATE_PK_PCT, VALUE_ALIASES, Table
from tellerlake.contract import Column as ContractColumn
from tellerlake.functions.typing import apply_contract
from tellerlake.operators.running import attach_one_row

Grade = Callable[[Column, Column], Column]


def failed_pct(failed: Column, total: Column) -> Column:
    return F.round(failed / F.greatest(total, F.lit(1)) * 100, 3)


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def always(level: str) -> Grade:
    return lambda failed, total: F.lit(level)


def if_any(level: str) -> Grade:
    return lambda failed, total: F.when(failed > 0, level).otherwise("info")


def beyond(percent: float, level: str, else_level: str) -> Grade:
    return lambda failed, total: F.when(failed * 100.0 > total * percent, level).otherwise(else_level)


@dataclass(frozen=True)
class Rule:
    """One line of the report. `failing` is an aggregate over the typed rows, or a constant; `listed_if_found` leaves the line out when nothing fails."""

    check: str
    column: str
    failing: Column
    grade: Grade
    remark: Column | None = None
    listed_if_found: bool = False

    def line(self, table: str, failed: Column, total: Column) -> Column:
        remark = F.lit(None) if self.remark is None else self.remark
        entry = F.struct(F.lit(table).alias("table_name"), F.lit(self.check).alias("check_name"), F.lit(self.column).alias("column_name"), failed.cast("bigint").alias("failed_rows"),
                         total.cast("bigint").alias("total_rows"), remark.cast("string").alias("detail"), self.grade(failed, total).alias("severity"))
        return F.when(failed > 0, entry) if self.listed_if_found else entry


def key_missing(table: Table) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in table.pk])


def column_rules(c: ContractColumn) -> Iterator[Rule]:
    """What the rows say about one contract column."""
    given = F.trim(F.col(f"{c.name}__text"))
    if c.not_null:
        yield Rule("not_null_violation", c.name, count_if(F.col(c.name).isNull()), if_any("warning"))
    yield Rule("cast_failure", c.name, count_if((F.coalesce(given, F.lit("")) != "") & F.col(c.name).isNull()), beyond(MAX_CAST_FAILURE_PCT, "critical", "warning"),
               F.lit(f"text that is no {c.type}"), listed_if_found=True)
    if c.name in VALUE_ALIASES:
        yield Rule("normalized_value", c.name, count_if(given.isin(*VALUE_ALIASES[c.name])), always("info"), listed_if_found=True)


def shape_rules(given: Sequence[str], table: Table) -> Iterator[Rule]:
    """What the delivered columns say: those the contract lacks, and those it misses (every row then lacks the value)."""
    own = set(table.names)
    for name in (n for n in given if n not in own and not n.startswith("_")):
        yield Rule("unexpected_column", name, F.lit(0), always("warning"), F.lit("not agreed on; carried along as text"))
    for c in (c for c in table.columns if c.name not in given):
        yield Rule("missing_column", c.name, F.count(F.lit(1)), always("critical" if c.not_null else "warning"), F.lit("not delivered; empty in every row"))


def table_rules(table: Table) -> Iterator[Rule]:
    """What the rows say about the table as a whole. `repeated` is joined to the measures: keys need an aggregate of their own."""
    key = ",".join(table.pk)
    yield Rule("empty_table", key, F.when(F.count(F.lit(1)) == 0, 1).otherwise(0), always("critical"), listed_if_found=True)
    yield Rule("null_primary_key", key, count_if(key_missing(table)), if_any("critical"))
    yield Rule("duplicate_primary_key", key, F.col("repeated"), beyond(MAX_DUPLICATE_PK_PCT, "warning", "info"), F.lit("only the newest row of a key stays"))
    if "process_date" in table.names:
        yield Rule("freshness", "process_date", F.lit(0), always("info"), F.concat(F.lit("newest: "), F.col("newest").cast("string")))


def repeated_keys(typed: DataFrame, table: Table) -> DataFrame:
    """One row: rows beyond the first of each complete key. Only keys are shuffled, combined before."""
    per_key = typed.where(~key_missing(table)).groupBy(*table.pk).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated"))


def quality_report(raw: DataFrame, table: Table) -> DataFrame:
    """The checks of one bronze table, one row each: one aggregate without a shuffle measures all rules, and one more the repeated keys."""
    typed = apply_contract(raw, table, keep_raw=True)
    rules = [*table_rules(table), *shape_rules(raw.columns, table), *(r for c in table.columns for r in column_rules(c))]
    newest = F.max("process_date") if "process_date" in table.names else F.lit(None)
    counted = [(i, r) for i, r in enumerate(rules) if r.check != "duplicate_primary_key"]
    measures = attach_one_row(typed.agg(F.count(F.lit(1)).alias("total"), newest.alias("newest"), *[r.failing.alias(f"m{i}") for i, r in counted]), repeated_keys(typed, table))
    lines = [r.line(table.name, F.col("repeated" if r.check == "duplicate_primary_key" else f"m{i}"), F.col("total")) for i, r in enumerate(rules)]
    report = measures.select(F.explode(F.array_compact(F.array(*lines))).alias("line")).select("line.*")
    return report.withColumn("failed_pct", failed_pct(F.col("failed_rows"), F.col("total_rows")))


def blocking(report: DataFrame) -> DataFrame:
    """Checks that keep a table's last good version in place."""
    return report.where(F.col("severity") == "critical")


def orphan_rows(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    keys = parent.select(F.col(parent_column).alias("_parent_key"))
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_parent_key"), "left_anti")


def orphan_report(links: Sequence[tuple[str, DataFrame, str, str, DataFrame, str]]) -> DataFrame:
    """Orphan counts per link (child name, child, column, parent name, parent, column); NULL children do not count.

    The child is reduced to its distinct key values with counts first, so the join moves one row per key.
    """
    parts = []
    for child_name, child, column, parent_name, parent, parent_column in links:
        keys = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
        known = parent.select(F.col(parent_column).alias("_p")).where(F.col("_p").isNotNull()).distinct()
        parts.append(
            keys.join(known, F.col("_k") == F.col("_p"), "left").agg(
                F.coalesce(F.sum(F.when(F.col("_p").isNull(), F.col("_n"))), F.lit(0)).alias("failed_rows"),
                F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
            ).select(
                F.lit(child_name).alias("table_name"), F.lit("orphan_foreign_key").alias("check_name"), F.lit(column).alias("column_name"),
                "failed_rows", "total_rows", F.lit(f"-> {parent_name}.{parent_column}").alias("detail"),
                F.when(F.col("failed_rows") > 0, "warning").otherwise("info").alias("severity"),
                failed_pct(F.col("failed_rows"), F.col("total_rows")).alias("failed_pct")))
    return reduce(DataFrame.unionByName, parts)


def key_uniqueness(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows against distinct keys, one row per table to be published."""
    parts = [
        df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("key_count"))
        .select(F.lit(name).alias("table_name"), "row_count", "key_count", (F.col("row_count") == F.col("key_count")).alias("is_unique"))
        for name, (df, keys) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def join_grain(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """A feature join must keep one row per key: rows before and after, duplicates, and the verdict."""
    counted = after.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_after"), F.count(F.lit(1)).alias("distinct_after"))
    return attach_one_row(before.agg(F.count(F.lit(1)).alias("rows_before")), counted).withColumn(
        "grain_kept", (F.col("rows_before") == F.col("rows_after")) & (F.col("rows_after") == F.col("distinct_after")))


def column_set_difference(expected: Sequence[str], actual: Sequence[str]) -> tuple[list[str], list[str]]:
    """(missing, unexpected) in contract and source order."""
    return [c for c in expected if c not in actual], [c for c in actual if c not in expected]
