"""Pages as a stream."""
