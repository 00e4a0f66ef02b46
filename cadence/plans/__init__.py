"""cadence.plans."""
