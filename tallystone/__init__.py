"""Tallystone: DataFrame operators for evaluating speech and translation output."""
