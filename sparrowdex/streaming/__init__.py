"""Incremental maintenance: batch and Structured Streaming forms."""
