"""plans of the co-registration engine."""
