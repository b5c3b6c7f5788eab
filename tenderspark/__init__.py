"""Procurement analytics on Spark."""
