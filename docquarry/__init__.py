"""docquarry: a PySpark-native analytics engine for documentation libraries."""
