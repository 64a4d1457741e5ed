"""Sources and sinks over Spark's own readers and writers."""
