"""sources of the tallystone engine."""
