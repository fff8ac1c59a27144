"""Structured Streaming form of message ingestion."""
