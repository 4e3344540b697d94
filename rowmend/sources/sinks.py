"""Result files: scored rows, repair reports, comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowmend.sources.csv import FORMAT

# What the scan reads back unchanged: quotes doubled, spaces kept.
WRITTEN = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, **FORMAT}


def write_scored_csv(detected: DataFrame, path: str, anomalies_only: bool = False) -> str:
    rows = detected.filter(F.col("prediction") == 1) if anomalies_only else detected
    rows.write.options(**WRITTEN).mode("errorifexists").csv(path)
    return path


def write_repair_report(report: DataFrame, path: str, row_id: str) -> dict[str, str]:
    """Repaired rows as CSV, summary and changes as JSON lines, one change per CSV row.

    A dry run writes nothing. One dataset serves the whole batch.
    """
    real = report.filter(~F.col("summary.dry_run"))
    if real.isEmpty():
        return {}
    root = path.rstrip("/")
    paths = {
        "repaired_rows": f"{root}/repaired_rows",
        "report": f"{root}/report",
        "changes": f"{root}/changes",
    }
    real.drop("original", "summary", "changes").write.options(**WRITTEN).csv(paths["repaired_rows"])
    real.select(row_id, "summary", "changes").write.json(paths["report"])
    real.select(row_id, F.inline("changes")).write.options(**WRITTEN).csv(paths["changes"])
    return paths


def write_comparison(table: DataFrame, path: str) -> str:
    """The model comparison as one small CSV; it has a row per model."""
    table.coalesce(1).write.options(**WRITTEN).csv(path)
    return path
