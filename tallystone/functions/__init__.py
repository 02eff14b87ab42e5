"""functions of the tallystone engine."""
