"""plans of the tallystone engine."""
