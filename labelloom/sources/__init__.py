"""Sources of the labelled-data engine."""
