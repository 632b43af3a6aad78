"""Sources and sinks: table-derived facts, axiom text, Parquet store."""
