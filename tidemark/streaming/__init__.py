"""Change tracking on streams."""
