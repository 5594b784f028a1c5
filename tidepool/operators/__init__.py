"""Search operators, vote aggregation, metrics, profiling and imputation as DataFrame operations."""
