"""Alert paths as Structured Streaming jobs."""
