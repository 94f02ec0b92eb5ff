"""Query plans: typed requests, join trees, compilation to DataFrames."""
