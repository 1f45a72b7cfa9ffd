"""operators of the measurement engine."""
