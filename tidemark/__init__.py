"""Snapshot change capture on Spark."""
