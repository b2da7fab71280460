"""DataFrame -> DataFrame operators (joins, aggregates, windows, ranking, metrics, ML)."""
