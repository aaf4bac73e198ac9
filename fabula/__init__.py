"""Bitemporal narrative graphs on Spark."""
