"""Connected components, which lineage uses too."""

from tablehealth.operators.components import components

__all__ = ["components"]
