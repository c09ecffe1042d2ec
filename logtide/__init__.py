"""Versioned key-value analytics on Spark: one change log, everything else derived from it."""
