"""operators of the co-registration engine."""
