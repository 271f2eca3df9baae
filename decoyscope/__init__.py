"""Spark-native analytics for decoy-sensor telemetry: ingest, sessions, detections, experiment scoring."""
