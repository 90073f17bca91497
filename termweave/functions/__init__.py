"""Part of the terminology engine."""
