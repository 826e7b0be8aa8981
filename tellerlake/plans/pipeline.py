"""Bronze to silver: contract, gate, newest version per key, published only when nothing blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tellerlake.contract import Table
from tellerlake.functions.typing import apply_contract
from tellerlake.operators.latest import keep_latest
from tellerlake.operators.quality import blocking, quality_report
from tellerlake.session import cut_lineage
from tellerlake.sources.versioned import append_report, write_version


def silver_rows(bronze: DataFrame, table: Table) -> DataFrame:
    """Typed rows, newest version per primary key; rows without a key are left out."""
    order = ([table.order_by] if table.order_by else []) + ["_ingested_at", "_source_file"]
    return keep_latest(apply_contract(bronze, table), table.pk, order)


def build_silver(bronze: DataFrame, table: Table, root: str) -> tuple[int | None, list[str]]:
    """Write a new version, or keep the last good one and return the reasons. The report is kept either way."""
    report = cut_lineage(quality_report(bronze, table))
    append_report(report, root)
    problems = [f"{r['check_name']}: {r['column_name']} ({r['failed_rows']})" for r in blocking(report).collect()]  # at most one row per check
    if problems:
        return None, problems
    return write_version(silver_rows(bronze, table), root, table.name), []


def run_silver(spark: SparkSession, bronze: dict[str, DataFrame], contract: dict[str, Table], root: str) -> dict[str, int]:
    """All tables; a blocked one does not stop the others, but the run fails at the end."""
    versions, blocked = {}, []
    for name, rows in bronze.items():
        version, problems = build_silver(rows, contract[name], root)
        if problems:
            blocked.append(f"{name}: {'; '.join(problems)}")
        else:
            versions[name] = version
    if blocked:
        raise RuntimeError("Quality gates failed:\n" + "\n".join(blocked))
    return versions
