"""Structured Streaming: an index that follows new file versions."""
