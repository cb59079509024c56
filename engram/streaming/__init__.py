"""Change feeds and keyed streaming state."""
