"""Building rows of the findings table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checkup import schemas
from checkup.session import materialize

INFO, SUGGEST, WARN, CRITICAL = "INFO", "SUGGEST", "WARN", "CRITICAL"


def _lit_or(c, dtype="string") -> Column:
    if c is None:
        return F.lit(None).cast(dtype)
    if isinstance(c, Column):
        return c.cast(dtype)
    return F.lit(c).cast(dtype)


def finding_columns(*, rule_id: str, rule_rank: int, severity, title, detail,
                    location_kind=None, location_identifier=None, evidence=None,
                    suggestion_kind=None, suggestion_sql=None, suggestion_note=None,
                    table_name=None, column_name=None, column_ordinal=None,
                    run_id=None, node_ord=None) -> list[Column]:
    """Columns of the findings schema, in order, from literals or expressions."""
    if location_kind is None:
        location = F.lit(None).cast(schemas.LOCATION)
    else:
        location = F.struct(_lit_or(location_kind).alias("kind"),
                            _lit_or(location_identifier).alias("identifier"))
    if suggestion_kind is None:
        suggestion = F.lit(None).cast(schemas.SUGGESTION)
    else:
        suggestion = F.struct(_lit_or(suggestion_kind).alias("kind"),
                              _lit_or(suggestion_sql).alias("sql"),
                              F.coalesce(_lit_or(suggestion_note), F.lit("")).alias("note"))
    return [
        F.lit(rule_id).alias("rule_id"),
        F.lit(rule_rank).cast("int").alias("rule_rank"),
        _lit_or(severity).alias("severity"),
        _lit_or(title).alias("title"),
        _lit_or(detail).alias("detail"),
        location.alias("location"),
        _lit_or(evidence).alias("evidence"),
        suggestion.alias("suggestion"),
        _lit_or(table_name).alias("table_name"),
        _lit_or(column_name).alias("column_name"),
        _lit_or(column_ordinal, "bigint").alias("column_ordinal"),
        _lit_or(run_id, "bigint").alias("run_id"),
        _lit_or(node_ord, "bigint").alias("node_ord"),
    ]


def empty_findings(spark) -> DataFrame:
    return spark.createDataFrame([], schemas.FINDINGS)


def union_findings(spark, parts: list[DataFrame]) -> DataFrame:
    if not parts:
        return empty_findings(spark)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flat_findings(findings: DataFrame) -> DataFrame:
    """Findings with location and suggestion spread into plain columns."""
    return findings.select(
        "rule_id", "severity", "title", "detail",
        F.col("location.kind").alias("location_kind"),
        F.col("location.identifier").alias("location_identifier"),
        F.col("suggestion.kind").alias("suggestion_kind"),
        F.col("suggestion.sql").alias("suggestion_sql"),
        F.col("suggestion.note").alias("suggestion_note"),
        "table_name", "column_name", "run_id", "node_ord",
    )


def conform(df: DataFrame, rule_id: str, rank: int) -> DataFrame:
    """``df`` with exactly the columns of the findings schema."""
    cols = []
    for f in schemas.FINDINGS.fields:
        if f.name == "rule_id":
            cols.append(F.lit(rule_id).alias("rule_id"))
        elif f.name == "rule_rank":
            cols.append(F.lit(rank).cast("int").alias("rule_rank"))
        elif f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def isolated_findings(spark, rules: list[tuple[str, int, Callable[[], DataFrame]]]) -> DataFrame:
    """The findings of several rules (id, rank, function that plans the rule), computed
    in one job and written once. A rule that fails, while it is planned or while it
    runs, is one WARN finding, and the others keep all theirs: when the one job
    fails, and only then, each rule is computed by itself to find the culprit."""
    planned = []
    for rule_id, rank, build in rules:
        try:
            planned.append((rule_id, rank, conform(build(), rule_id, rank), None))
        except Exception as exc:  # noqa: BLE001 -- one bad rule must not stop the others
            planned.append((rule_id, rank, None, exc))
    failed = [failed_rule(spark, r, k, exc) for r, k, _, exc in planned if exc is not None]
    good = [(r, k, df) for r, k, df, exc in planned if exc is None]
    if not good:
        return union_findings(spark, failed)
    try:
        return union_findings(spark, [materialize(union_findings(spark, [df for _, _, df in good]), "findings"), *failed])
    except Exception:  # noqa: BLE001 -- some rule failed while it ran
        parts = []
        for rule_id, rank, df in good:
            try:
                parts.append(materialize(df, "findings-of-rule"))
            except Exception as exc:  # noqa: BLE001
                parts.append(failed_rule(spark, rule_id, rank, exc))
        return union_findings(spark, parts + failed)


def failed_rule(spark, rule_id: str, rank: int, exc: Exception) -> DataFrame:
    """The one finding that stands for a rule that failed."""
    return spark.range(1).select(*finding_columns(
        rule_id=rule_id, rule_rank=rank, severity=WARN, title=f"Advisor {rule_id} failed",
        detail=str(exc)))
