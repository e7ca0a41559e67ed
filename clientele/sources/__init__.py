"""Readers, table contracts, test-table adapters and sinks."""
