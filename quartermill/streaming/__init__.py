"""Structured Streaming: resumable audits and event windows."""
