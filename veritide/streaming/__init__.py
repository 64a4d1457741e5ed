"""Controls over streams, in Structured Streaming."""
