"""Readers and writers, and the adapter views over the driver tables."""
