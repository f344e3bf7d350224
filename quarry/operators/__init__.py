"""DataFrame operators: ranking, aggregates, grids, joins, splits, features,
metrics, models and tuning. Each takes and returns DataFrames."""
