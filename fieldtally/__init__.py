"""Spark-native accounting for device telemetry: every reading is stored, delivered or counted in a gap."""

__version__ = "0.1.0"
