"""sources of the measurement engine."""
