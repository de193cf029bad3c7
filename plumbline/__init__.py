"""Spark-native analytics over flight and telemetry logs."""
