"""Task-duration analytics for service orders, as Spark DataFrame operators and pipelines."""
