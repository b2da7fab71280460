"""Sources and sinks: CSV, stored tables, registry tables."""
