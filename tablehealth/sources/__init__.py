"""Sources and sinks: tables, catalog manifests, guarded SQL and the shared scratch folder."""
