"""cadence.streaming."""
