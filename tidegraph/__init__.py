"""tidegraph: leakage-safe, graph-aware analytics of payment transactions on Spark DataFrames."""
