"""Test suggestions: rules over profile rows.

A rule is data, so a user adds one by extending the list. All rules of a column are evaluated in
the row that holds its profile: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehealth.functions.text import is_id_name, is_time_name
from tablehealth.operators import profile as profiling

# Thresholds of the rules.
FEW_VALUES = 10
MIN_ROWS = 10
TIME_MAX_NULL_RATE = 1.0
ID_MAX_NULL_RATE = 5.0
ID_MIN_UNIQUE_RATE = 90.0


@dataclass(frozen=True)
class Rule:
    """A suggested test; ``when`` and the texts may use any column of the profile."""

    test: str
    confidence: Column
    when: Column
    reason: Column
    values: Column | None = None


def rules(values: str = "exact", parity: bool = False) -> list[Rule]:
    """The standard rules, in the order in which their results are listed.

    ``values="sample"`` lists accepted values from ``sample_values`` instead of the full list.
    ``parity=True`` judges nulls by the rounded rate, so that very few nulls pass as none.
    """
    if values not in ("exact", "sample"):
        raise ValueError(f"values must be 'exact' or 'sample', got {values!r}")
    total, filled = F.col("total_rows"), F.col("non_null_count")
    unique, name = F.col("unique_count"), F.col("column")
    null_rate, unique_rate = F.col("null_rate"), F.col("unique_rate")
    null_text, unique_text = null_rate.cast("string"), unique_rate.cast("string")
    exact = F.col("is_exact")

    no_nulls = (null_rate == 0.0) if parity else (filled == total)
    time_like = ~no_nulls & (null_rate < TIME_MAX_NULL_RATE) & is_time_name(name)
    all_unique = exact & (unique == total) & (total > 0)
    accepted = _accepted(values)
    return [
        Rule(
            "not_null",
            F.lit("high"),
            no_nulls,
            F.concat(F.lit("All "), total, F.lit(" rows have a value")),
        ),
        Rule(
            "not_null",
            F.lit("medium"),
            time_like,
            F.concat(F.lit("A time that "), null_text, F.lit(" percent of rows lack")),
        ),
        Rule(
            "unique",
            F.lit("high"),
            all_unique,
            F.concat(
                F.lit("No value repeats: "),
                F.format_number(unique, 0),
                F.lit(" in "),
                F.format_number(total, 0),
                F.lit(" rows"),
            ),
        ),
        Rule(
            "accepted_values",
            F.when(accepted.isNotNull(), "high").otherwise("medium"),
            (unique > 0) & (unique <= FEW_VALUES) & (total >= MIN_ROWS),
            F.concat(F.lit("Takes only "), unique, F.lit(" different values")),
            accepted,
        ),
        Rule(
            "not_null",
            F.lit("medium"),
            is_id_name(name) & ~no_nulls & ~time_like & (null_rate <= ID_MAX_NULL_RATE),
            F.concat(F.lit("A key that "), null_text, F.lit(" percent of rows lack")),
        ),
        Rule(
            "unique",
            F.lit("medium"),
            is_id_name(name) & ~all_unique & (unique_rate >= ID_MIN_UNIQUE_RATE),
            F.concat(F.lit("A key with "), unique_text, F.lit(" different values per hundred rows")),
        ),
    ]


def suggest(profile: DataFrame, rule_list: Sequence[Rule] | None = None) -> DataFrame:
    """One row per suggested test."""
    return grouped(profile, rule_list).select("table", "ordinal", "column", F.inline("tests"))


def grouped(profile: DataFrame, rule_list: Sequence[Rule] | None = None) -> DataFrame:
    """One row per column with suggestions, its tests as an array in rule order."""
    return with_tests(profile, rule_list).select("table", "ordinal", "column", "tests").where(F.size("tests") > 0)


def with_tests(profile: DataFrame, rule_list: Sequence[Rule] | None = None) -> DataFrame:
    """Every row of a profile with its suggested ``tests`` in rule order, an empty array where there are none."""
    no_values = F.lit(None).cast("array<string>")
    cases = []
    for order, rule in enumerate(rule_list or rules(), 1):
        values = no_values if rule.values is None else rule.values
        cases.append(
            F.when(
                rule.when,
                F.struct(
                    F.lit(order).alias("rule_order"),
                    F.lit(rule.test).alias("test_name"),
                    rule.confidence.alias("confidence"),
                    values.alias("values"),
                    rule.reason.alias("reason"),
                ),
            )
        )
    return profile.withColumn("tests", F.filter(F.array(*cases), lambda t: t.isNotNull()))


def as_test_entries(grouped_suggestions: DataFrame) -> DataFrame:
    """The same grouping in registry form: tests as (name, JSON config)."""
    return grouped_suggestions.select(
        "table",
        "ordinal",
        "column",
        F.transform(
            "tests",
            lambda t: F.struct(
                t["test_name"].alias("name"),
                F.when(
                    t["values"].isNotNull(), F.to_json(F.struct(t["values"].alias("values")))
                ).alias("config"),
            ),
        ).alias("tests"),
    )


def notes(profile: DataFrame) -> DataFrame:
    """A note for every table too small for its statistics to mean much."""
    first = profile.where(F.col("total_rows") < MIN_ROWS).groupBy("table").agg(
        F.first("total_rows").alias("total_rows")
    )
    return first.select(
        "table",
        F.concat(
            F.lit("Only "), F.col("total_rows"), F.lit(" rows: suggestions may not be reliable")
        ).alias("note"),
    )


def suggest_table(
    df: DataFrame,
    table: str = "table",
    *,
    mode: str = "exact",
    parity: bool = False,
    values: str = "exact",
) -> DataFrame:
    """Profile a table and suggest tests for it; options as in ``profile`` and :func:`rules`."""
    rows = profiling.profile(df, table, mode=mode)
    if values == "sample":
        rows = with_samples(rows, df, table)
    return suggest(rows, rules(values, parity))


def with_samples(profile: DataFrame, df: DataFrame, table: str = "table", n: int = 3) -> DataFrame:
    """Add ``sample_values``, the first ``n`` values of each column."""
    samples = profiling.sample_values(df, table, n).select("ordinal", "sample_values")
    return profile.join(samples, "ordinal", "left")


def _accepted(values: str) -> Column:
    if values == "exact":
        return F.when(F.size("values") > 0, F.col("values"))
    distinct = F.array_sort(F.array_distinct(F.array_compact("sample_values")))
    return F.when((F.size(distinct) > 0) & (F.size(distinct) <= FEW_VALUES), distinct)
