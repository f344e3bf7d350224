"""Incremental (Structured Streaming) runs of the stateless log analyses."""
