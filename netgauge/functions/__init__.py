"""functions of the measurement engine."""
