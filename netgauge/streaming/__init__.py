"""streaming of the measurement engine."""
