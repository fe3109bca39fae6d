"""Text predicates as Column expressions, evaluated in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Naming and identifier patterns, layer prefixes and name suffixes.
MODEL_NAME = "^[a-z][a-z0-9_]*$"
IDENTIFIER = "^[a-zA-Z_][a-zA-Z0-9_]{0,127}$"
LAYERS = (
    ("staging", "^stg_"),
    ("intermediate", "^int_"),
    ("marts_fact", "^fct_"),
    ("marts_dim", "^dim_"),
    ("snapshot", "^scd_|_snapshot$"),
)
TIME_SUFFIXES = ("_at", "_date", "_ts")

# Any character that is not Unicode white space; U+001C..U+001F also count as space.
_VISIBLE = r"(?U)[^\s\x1c-\x1f]"


def is_present(text: Column) -> Column:
    """True when a description holds something other than white space; null counts as blank."""
    return F.coalesce(text.rlike(_VISIBLE), F.lit(False))


def is_model_name(name: Column) -> Column:
    return F.coalesce(name.rlike(MODEL_NAME), F.lit(False))


def naming_issue(name: Column) -> Column:
    """Text of the naming problem, empty when the name is fine."""
    return F.when(is_model_name(name), F.lit("")).otherwise(
        F.concat(
            F.lit("Only small letters, digits and underscores make a model name: "),
            F.coalesce(name, F.lit("")),
        )
    )


def layer_of(name: Column) -> Column:
    """Layer a name's prefix points to. Informational: no score depends on it."""
    layer = F.lit("other")
    for label, pattern in reversed(LAYERS):
        layer = F.when(name.rlike(pattern), F.lit(label)).otherwise(layer)
    return layer


def is_identifier(name: Column) -> Column:
    return F.coalesce(name.rlike(IDENTIFIER), F.lit(False))


def is_safe_identifier(name: str) -> bool:
    return re.match(IDENTIFIER, name) is not None


def validate_identifier(name: str) -> str:
    """Return ``name`` unchanged, or raise ``ValueError`` when it is not a plain identifier."""
    if not is_safe_identifier(name):
        raise ValueError(
            f"Not a plain identifier: {name!r} (a letter or underscore, then at most 127 "
            "letters, digits or underscores)"
        )
    return name


def is_time_name(name: Column) -> Column:
    lowered = F.lower(name)
    matches = F.lit(False)
    for suffix in TIME_SUFFIXES:
        matches = matches | lowered.endswith(suffix)
    return matches


def is_id_name(name: Column) -> Column:
    lowered = F.lower(name)
    return lowered.endswith("_id") | (lowered == "id")


def test_name(entry: Column) -> Column:
    """Name of a test entry: the text itself, or the first key when it is a JSON object."""
    return F.when(
        entry.startswith("{"), F.coalesce(F.get(F.json_object_keys(entry), F.lit(0)), F.lit(""))
    ).otherwise(entry)


test_name.__test__ = False  # not a test, whatever pytest thinks of the name


def test_config(entry: Column) -> Column:
    """Configuration of an object-form entry as JSON text, null for plain names."""
    return F.when(entry.startswith("{"), F.get(_first_values(entry), F.lit(0)))


test_config.__test__ = False


def _first_values(entry: Column) -> Column:
    return F.map_values(F.from_json(entry, "map<string,string>"))


def last_segment(node_id: Column) -> Column:
    return F.element_at(F.split(node_id, r"\."), -1)


def types_agree(declared: Column, actual: Column) -> Column:
    """Case-insensitive substring match either way; an empty declared type agrees with anything."""
    left, right = F.lower(declared), F.lower(actual)
    return (
        (F.coalesce(declared, F.lit("")) == "") | left.contains(right) | right.contains(left)
    )


def round_even(value: Column, digits: int = 0) -> Column:
    """Round half to even, which is how the percentages and scores are defined."""
    return F.bround(value, digits)


def round_tenth(value: Column) -> Column:
    """One decimal of a score from 0 to 100, rounded by the number's exact binary value.

    ``bround`` goes by the shortest decimal text, which makes ties of numbers that lie just beside one. Times a large
    power of two the score is a whole number, and so are its twenty-fold and what is left of that after the tenths.
    """

    def rounded(bits: int) -> Column:
        scaled = (value * F.lit(float(1 << bits))).cast("long") * 20
        tenths = F.shiftright(scaled, bits + 1)
        left = scaled - F.shiftleft(tenths, bits + 1)
        half = F.lit(1 << bits)
        up = (left > half) | ((left == half) & (tenths % 2 == 1))
        return (tenths + F.when(up, 1).otherwise(0)) / F.lit(10.0)

    return F.when(value < 1, rounded(58)).otherwise(rounded(52))


def percent(part: Column, whole: Column, digits: int, when_empty: float) -> Column:
    """``part / whole`` as a rounded percentage, with a fixed value for an empty whole."""
    return F.when(whole == 0, F.lit(when_empty)).otherwise(round_even(part / whole * 100, digits))
