"""Table and catalog health on Spark: profiles, drift, test suggestions, audits and lineage."""

from tablehealth.operators import audit, drift, lineage, profile, registry, snapshots, suggest, versions
from tablehealth.plans import health
from tablehealth.plans.tools import Workspace
from tablehealth.sources import adhoc, footers, manifest, tables

__all__ = [
    "Workspace",
    "adhoc",
    "audit",
    "drift",
    "footers",
    "health",
    "lineage",
    "manifest",
    "profile",
    "registry",
    "snapshots",
    "suggest",
    "tables",
    "versions",
]
