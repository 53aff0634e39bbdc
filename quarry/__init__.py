"""An analytics engine on PySpark: a SQL dialect, spatial and text queries, versioned tables."""
