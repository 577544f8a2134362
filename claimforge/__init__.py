"""claimforge: labelled-text analytics as lazy Spark plans."""

__all__ = ["functions", "operators", "plans", "sources"]
