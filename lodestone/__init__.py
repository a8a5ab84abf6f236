"""Link-graph and search analytics on Spark."""
