"""Part of the log engine."""
