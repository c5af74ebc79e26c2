"""Part of the lexispan engine."""
