"""Network-telemetry analytics on Spark."""
