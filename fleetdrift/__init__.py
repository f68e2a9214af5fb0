"""fleetdrift: dependency- and API-drift analytics for whole fleets of repositories, on Spark."""

__all__ = ["functions", "sources", "operators", "plans", "streaming"]
