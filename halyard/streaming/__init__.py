"""Index maintenance as Structured Streaming: ingestion, queues, debouncing, progress."""
