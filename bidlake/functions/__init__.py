"""Column-level functions and aggregate metrics."""
