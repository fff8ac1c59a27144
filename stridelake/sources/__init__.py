"""Schemas, readers, ingestion and writers."""
