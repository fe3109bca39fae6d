"""The named tools, over a workspace of manifests and the tables they describe.

Every tool returns a DataFrame. Where a tool takes a model name, that model's table is found by
its schema and its alias.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tablehealth.operators import audit, drift, lineage, profile, registry, suggest
from tablehealth.plans import health
from tablehealth.schemas import REGISTRY_COLUMNS
from tablehealth.sources import adhoc, manifest
from tablehealth.sources.scratch import stage
from tablehealth.sources.tables import columns_of, read_table


@dataclass(frozen=True)
class Workspace:
    """Manifests of one or more projects, and how to open a table by schema and name."""

    spark: SparkSession
    manifests: DataFrame
    open_table: Callable[[str, str], DataFrame] | None = None

    @property
    def models(self) -> DataFrame:
        return manifest.assets(self.manifests)

    @property
    def exposures(self) -> DataFrame:
        return manifest.exposures(self.manifests)

    def list_models(self) -> DataFrame:
        return audit.list_models(self.models)

    def get_model_details(self, model: str) -> DataFrame:
        """The model's row with all details, see :func:`tablehealth.operators.audit.details`."""
        return audit.details(audit.find_model(self.models, model))

    def audit_project(self) -> DataFrame:
        return audit.audit_projects(audit.audit_models(self.models))

    def worst_models(self) -> DataFrame:
        """The models of each project with the least coverage."""
        return audit.worst_models(audit.audit_models(self.models))

    def naming_violations(self) -> DataFrame:
        return audit.naming_violations(audit.audit_models(self.models))

    def orphans(self, match: str = "name") -> DataFrame:
        """Models that nothing consumes and no exposure uses."""
        return lineage.orphans(lineage.graph_nodes(self.models, self.exposures, match))

    def roots(self) -> DataFrame:
        return lineage.roots(self.models)

    def hubs(self, match: str = "name") -> DataFrame:
        """Models with many consumers, those with most first."""
        return lineage.by_fan_out(lineage.fan_out(self.models, match=match))

    def check_test_coverage(self, sort: bool = False) -> DataFrame:
        return audit.coverage_bands(audit.audit_models(self.models), sort)

    def analyze_dag(self, match: str = "name") -> DataFrame:
        return _dag(self._staged_models(), self.exposures, match)

    def longest_chains(self, match: str = "name") -> DataFrame:
        """The models on the longest chain of each project."""
        return lineage.longest_chains(self.models, match)

    def get_project_health(self) -> DataFrame:
        return self._health()[0]

    def recommended_actions(self) -> DataFrame:
        return health.dashboard_actions(*self._health())

    def _staged_models(self) -> DataFrame:
        """The models without their SQL, parsed and written once for all steps that follow."""
        return stage(self.models.drop("raw_sql", "compiled_sql", "config", "tags"))

    def _health(self) -> tuple[DataFrame, DataFrame]:
        """The dashboard and the audit of the models."""
        models = self._staged_models()
        audited = audit.audit_models(models)
        return health.dashboard(audit.audit_projects(audited), _dag(models, self.exposures, "name")), audited

    def profile_model(
        self, model: str, mode: str = "exact", project_id: str | None = None
    ) -> DataFrame:
        """The model's columns, with ``sample_values`` of each."""
        table = self._table(model, project_id)
        return suggest.with_samples(profile.profile(table, model, mode=mode), table, model)

    def sample_rows(self, model: str, n: int = 5, project_id: str | None = None) -> DataFrame:
        return profile.sample_rows(self._table(model, project_id), n)

    def execute_query(
        self,
        sql: str,
        args: dict[str, Any] | list[Any] | None = None,
        limit: int | None = None,
    ) -> DataFrame:
        return adhoc.execute_query(self.spark, sql, args, limit)

    def detect_schema_drift(
        self, model: str, canonical: bool = False, project_id: str | None = None
    ) -> DataFrame:
        """Drift of one model's table; ``project_id`` is needed where several projects have the name."""
        place = self._location(model, project_id)
        found = audit.find_model(self.models, model).where(F.col("project_id") == place["project_id"])
        declared = manifest.asset_columns(found).select(
            F.lit(model).alias("table"), "pos", "column", "data_type"
        )
        actual = columns_of(self.spark, {model: self._open(place)})
        return drift.ordered(drift.detect(actual, declared, canonical=canonical))

    def detect_all_drift(self, actual: DataFrame, canonical: bool = False) -> DataFrame:
        """Drift of every model of every project at once.

        ``actual`` has (project_id, table, ordinal, column, data_type) as a catalog lists them; tables are
        named like the models.
        """
        by = ("project_id", "table")
        declared = manifest.asset_columns(self.models).select(
            "project_id", F.col("model").alias("table"), "pos", "column", "data_type"
        )
        return drift.ordered(drift.detect(actual, declared, by=by, canonical=canonical), by)

    def suggest_tests(
        self,
        model: str,
        mode: str = "exact",
        values: str = "exact",
        project_id: str | None = None,
    ) -> DataFrame:
        """Suggested tests; ``values`` as in ``suggest.rules``. See also :meth:`suggestion_note`."""
        table = self._table(model, project_id)
        return suggest.suggest_table(table, model, mode=mode, values=values)

    def suggestion_note(self, model: str, project_id: str | None = None) -> DataFrame:
        """A row that warns of a table with too few rows; no row otherwise."""
        rows = self._table(model, project_id).agg(F.count(F.lit(1)).alias("total_rows"))
        return suggest.notes(rows.select(F.lit(model).alias("table"), "total_rows"))

    def update_docs(self, existing: DataFrame, proposals: DataFrame) -> DataFrame:
        """Merge proposed columns into the registry; save the result with ``registry.save``."""
        return registry.merge_columns(existing, proposals)

    def describe_models(self, existing: DataFrame, proposals: DataFrame) -> DataFrame:
        """Merge proposed descriptions of whole models into the registry of models."""
        return registry.merge_models(existing, proposals)

    def generate_model_docs(self, model: str, mode: str = "exact", project_id: str | None = None) -> DataFrame:
        """Proposals drawn from the model's data, not merged yet.

        A model whose table cannot be opened or read gives no rows.
        """
        place = self._location(model, project_id)
        rows = self._readable_profile(place, model, mode)
        if rows is None:
            return self.spark.createDataFrame([], REGISTRY_COLUMNS)
        tests = suggest.as_test_entries(suggest.grouped(rows))
        return registry.from_suggestions(tests, place["project_id"], model)

    def preview_docs(self, model: str, mode: str = "exact", project_id: str | None = None) -> DataFrame:
        """The proposals beside what they rest on: a row per column of the table with the model's description, the
        column's profile and its suggested ``tests``, an empty list where there are none.

        A model whose table cannot be opened or read gives one row with its description and no column.
        """
        place = self._location(model, project_id)
        about = self.spark.createDataFrame(
            [(place["project_id"], model, place["description"])], "project_id string, model string, description string"
        )
        rows = self._readable_profile(place, model, mode)
        if rows is None:
            return about.withColumn("column", F.lit(None).cast("string"))
        return about.join(suggest.with_tests(rows), F.col("model") == F.col("table"), "left").drop("table")

    def _readable_profile(self, place: Row, model: str, mode: str) -> DataFrame | None:
        """The profile, computed here to see whether it can be: a row per column."""
        try:
            rows = profile.profile(self._open(place), model, mode=mode)
            return self.spark.createDataFrame(rows.collect(), rows.schema)
        except (PySparkException, Py4JJavaError, ValueError):
            return None

    def profile_all(self, models: Sequence[str], mode: str = "exact", project_id: str | None = None) -> DataFrame:
        return profile.profile_many({m: self._table(m, project_id) for m in models}, mode=mode)

    def _location(self, model: str, project_id: str | None = None) -> Row:
        found = audit.find_model(self.models, model).select(
            "project_id", "schema", "description", F.coalesce("alias", "name").alias("table")
        )
        if project_id is not None:
            found = found.where(F.col("project_id") == project_id)
        rows = found.take(2)
        if not rows:
            raise ValueError(f"There is no model {model!r}")
        if len(rows) > 1:
            raise ValueError(f"Several projects have a model {model!r}; name one by project_id")
        row = rows[0]
        if not row["schema"]:
            raise ValueError(f"Model {model!r} has no schema")
        return row

    def _table(self, model: str, project_id: str | None = None) -> DataFrame:
        return self._open(self._location(model, project_id))

    def _open(self, place: Row) -> DataFrame:
        if self.open_table is not None:
            return self.open_table(place["schema"], place["table"])
        return read_table(self.spark, place["table"], place["schema"])


def _dag(models: DataFrame, exposures: DataFrame, match: str) -> DataFrame:
    return lineage.summarize(lineage.graph_nodes(models, exposures, match), lineage.node_depths(models, match))
