"""functions of the co-registration engine."""
