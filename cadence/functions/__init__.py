"""cadence.functions."""
