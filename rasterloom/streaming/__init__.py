"""streaming of the co-registration engine."""
