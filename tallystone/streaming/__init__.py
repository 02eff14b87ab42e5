"""streaming of the tallystone engine."""
