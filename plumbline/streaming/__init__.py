"""plumbline streaming."""
