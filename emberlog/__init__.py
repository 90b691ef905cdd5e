"""Spark-native analytics over journals of durable, event-driven work."""
