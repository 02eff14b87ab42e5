"""operators of the tallystone engine."""
