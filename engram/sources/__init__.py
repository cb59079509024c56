"""Readers of the store's tables and the append-only collection store."""
