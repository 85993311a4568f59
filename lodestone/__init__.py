"""Evidence analytics on Spark: retrieval, audit and evaluation as DataFrame plans."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
