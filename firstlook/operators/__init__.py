"""Table operators: plain functions from DataFrame to DataFrame or to a small report."""
