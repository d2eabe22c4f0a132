"""Structured Streaming: profiles and activity over edges as they arrive."""
