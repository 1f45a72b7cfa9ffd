"""plans of the measurement engine."""
