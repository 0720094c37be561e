"""Column expressions: names, time, units, meteorology, quality, scores."""
