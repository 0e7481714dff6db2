"""A Spark engine for labelled datasets, model evaluation and monitoring."""
