"""DataFrame operators: projections, joins, aggregates, windows, quality, corrections, vectors."""
