"""Outputs: findings JSON (K1), DDL scripts (K2), report lines (K3), history (K4)."""

from checkup.sinks.report import (  # noqa: F401
    ddl_lines,
    infer_report_lines,
    record_runs,
    report_lines,
    write_ddl_script,
    write_findings_json,
    write_report,
)
