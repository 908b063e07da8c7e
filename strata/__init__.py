"""A query and data-processing engine on Spark."""
