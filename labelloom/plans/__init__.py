"""Plans of the labelled-data engine."""
