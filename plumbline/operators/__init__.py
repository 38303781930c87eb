"""plumbline operators."""
