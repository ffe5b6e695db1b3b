"""Readers, adapters and sinks for event logs and their dimensions."""
