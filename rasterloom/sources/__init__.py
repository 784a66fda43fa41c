"""sources of the co-registration engine."""
