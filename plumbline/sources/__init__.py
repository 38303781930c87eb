"""plumbline sources."""
