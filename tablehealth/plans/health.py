"""The health dashboard of every project and the actions it recommends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth.operators import audit

# The limits below or above which an action is recommended.
LOW_OVERALL = 50
LOW_TEST = 60
LOW_COLUMN_DOC = 30
REPORT_MODEL_DOC = 80
REPORT_COLUMN_DOC = 50
EXCELLENT_OVERALL = 90
NAMED_WORST = 3


def dashboard(project_audit: DataFrame, graph_summary: DataFrame) -> DataFrame:
    """Scores and graph figures side by side, one row per project."""
    return project_audit.join(graph_summary.drop("total_models"), "project_id", "left")


def dashboard_actions(dashboard_rows: DataFrame, model_audit: DataFrame) -> DataFrame:
    """Recommended actions per project, numbered in order of priority."""
    names = (
        audit.worst_models(model_audit, NAMED_WORST)
        .groupBy("project_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("worst"))
        .select("project_id", F.array_join("worst.name", ", ").alias("worst_names"))
    )
    rows = dashboard_rows.join(names, "project_id", "left")
    return _numbered(
        rows,
        [
            (F.col("overall_score") < LOW_OVERALL, F.lit("Low overall quality: see audit_project")),
            (
                F.col("test_score") < LOW_TEST,
                F.concat(F.lit("Run suggest_tests on: "), F.col("worst_names")),
            ),
            (
                F.col("orphan_models") > 0,
                F.concat(
                    F.lit("Review "),
                    F.col("orphan_models"),
                    F.lit(" orphan models (first: "),
                    F.col("first_orphan"),
                    F.lit(")"),
                ),
            ),
            (
                F.col("column_doc_score") < LOW_COLUMN_DOC,
                F.lit("Run generate_model_docs to document columns"),
            ),
        ],
    )


def report_actions(project_audit: DataFrame) -> DataFrame:
    """Recommendations that go with the audit report."""
    return _numbered(
        project_audit,
        [
            (F.col("model_doc_score") < REPORT_MODEL_DOC, F.lit("Describe undocumented models")),
            (F.col("test_score") < LOW_TEST, F.lit("Run suggest_tests on the worst models")),
            (
                F.col("column_doc_score") < REPORT_COLUMN_DOC,
                F.lit("Run generate_model_docs to document columns"),
            ),
            (F.col("overall_score") >= EXCELLENT_OVERALL, F.lit("Excellent project quality")),
        ],
    )


def _numbered(rows: DataFrame, rules: list[tuple[Column, Column]]) -> DataFrame:
    texts = F.filter(
        F.array(*[F.when(condition, text) for condition, text in rules]),
        lambda text: text.isNotNull(),
    )
    return rows.select("project_id", F.posexplode(texts).alias("at", "action")).select(
        "project_id", (F.col("at") + 1).alias("priority"), "action"
    )
